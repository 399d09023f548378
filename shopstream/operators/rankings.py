"""Categories by clicks, orders and payments; top categories and their top sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_to_longs


def category_events(details: DataFrame) -> DataFrame:
    """A row per category that an action clicks, orders or pays: session_id, kind, category_id."""
    none = F.array().cast("array<bigint>")

    def of(kind: str, ids: Column) -> Column:
        return F.transform(F.coalesce(ids, none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("category_id")))

    clicks = F.when(F.col("click_category_id").isNotNull(), F.array(F.col("click_category_id").cast("long")))
    events = F.concat(of("click", clicks), of("order", csv_to_longs("order_category_ids")), of("pay", csv_to_longs("pay_category_ids")))
    return details.select("session_id", F.explode(events).alias("e")).select("session_id", "e.kind", "e.category_id")


def category_counts(events: DataFrame) -> DataFrame:
    """Clicks, orders and payments of each category, in one grouping."""
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"{kind}_count")
    return events.groupBy("category_id").agg(count("click"), count("order"), count("pay"))


def category_counts_salted(events: DataFrame, n: int = 10) -> DataFrame:
    """The same in two steps, for a category that most rows have."""
    salt = F.pmod(F.xxhash64("session_id", "kind"), F.lit(n)).alias("_salt")
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"{kind}_count")
    part = events.groupBy("category_id", salt).agg(count("click"), count("order"), count("pay"))
    return part.groupBy("category_id").agg(*[F.sum(f"{k}_count").alias(f"{k}_count") for k in ("click", "order", "pay")])


def top_categories(counts: DataFrame, n: int = 10) -> DataFrame:
    """By clicks, then orders, then payments, all descending; ties by id."""
    return counts.orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")).limit(n)


def session_category_clicks(details: DataFrame) -> DataFrame:
    clicks = details.where("click_category_id is not null")
    return clicks.groupBy("session_id", F.col("click_category_id").alias("category_id")).agg(F.count(F.lit(1)).alias("click_count"))


def top_sessions(clicks: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The sessions with most clicks in each of the categories; ties by session."""
    order = Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    own = clicks.join(categories.select("category_id"), "category_id", "left_semi")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_session_details(top: DataFrame, details: DataFrame, dedupe: bool = False) -> DataFrame:
    """Actions of top sessions: once for each category that a session is top in, or once."""
    sessions = top.select("session_id")
    return details.join(sessions.distinct() if dedupe else sessions, "session_id")
