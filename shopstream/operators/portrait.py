"""User portraits: sign-in facts and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_day


def cookie_user_signin(events: DataFrame, views: DataFrame, day: str) -> DataFrame:
    """Who signed in with which cookie on which day: events and views together, repeats kept."""
    pick = lambda df, time: df.where(F.col("data_date") == day).select("userid", "cookieid", epoch_day(time).alias("signdate"), "data_date")
    return pick(events, "eventtime").unionByName(pick(views, "viewtime"))


def _tag(df: DataFrame, tag: str, value: str, day: str) -> DataFrame:
    return df.select("user_id", F.lit(tag).alias("tag_id"), F.col(value).cast("string").alias("value"), F.lit(day).alias("dt"))


def attribute_tags(users: DataFrame, day: str) -> DataFrame:
    """Gender and age decade."""
    age = users.withColumn("_decade", F.floor(F.col("age") / 10) * 10)
    return _tag(users, "ATTRITUBE_U_01_001", "sex", day).unionByName(_tag(age, "ATTRITUBE_U_02_001", "_decade", day))


def active_days(events: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Distinct days with events in the last days, the given one included."""
    at, last = F.to_date("ts"), F.lit(day).cast("date")
    own = events.where(at.between(F.date_sub(last, days - 1), last))
    return _tag(own.groupBy("user_id").agg(F.count_distinct(at).alias("n")), "ACTION_U_01_001", "n", day)


def active_consumers(orders: DataFrame, day: str, days: int = 30, more_than: int = 2) -> DataFrame:
    """Users with more than so many orders in the last days."""
    at, last = F.to_date("create_time"), F.lit(day).cast("date")
    own = orders.where(at.between(F.date_sub(last, days - 1), last)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return _tag(own.where(F.col("n") > more_than), "CONSUME_U_01_001", "n", day)


def tag_increment(before: DataFrame, now: DataFrame) -> DataFrame:
    """The incremental tag table of a day: tags that are new or have another value than in the full table before."""
    known = before.select(*[F.col(c).alias(f"_{c}") for c in ("user_id", "tag_id", "value")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("user_id", "tag_id", "value")]
    return now.join(known, same, "left_anti")


def tag_full(before: DataFrame, increment: DataFrame) -> DataFrame:
    """The full tag table after a day: of each user and tag the last value."""
    rest = F.max_by("value", "dt").alias("value"), F.max("dt").alias("dt")
    return before.unionByName(increment).groupBy("user_id", "tag_id").agg(*rest)


def wide_tags(tags: DataFrame, tag_ids: list[str]) -> DataFrame:
    """A row per user and day with a column per tag."""
    return tags.groupBy("user_id", "dt").pivot("tag_id", tag_ids).agg(F.max("value"))
