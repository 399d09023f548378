"""Session analytics: aggregation, profiles, filters, histograms, stratified extract."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import opt_between, opt_equal, opt_overlaps, param, param_list, ratio
from ..functions.times import date_hour, format_time, parse_time
from .skew import bounded_join

#: Visit-length buckets in seconds and step buckets: name, least, most.
VISIT_BUCKETS = [("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60), ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None)]
STEP_BUCKETS = [("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("31_60", 31, 60), ("60", 61, None)]


def scan_actions(actions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of an inclusive date range; the predicate reaches the scan."""
    return actions.where(F.col("date").between(start, end)) if start and end else actions


def aggregate_sessions(actions: DataFrame) -> DataFrame:
    """A row per session: user, distinct keywords and clicked categories (sorted), times, seconds, steps."""
    at = parse_time("action_time")
    start, end = F.min(at), F.max(at)
    return actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.array_sort(F.collect_set(F.when(F.col("search_keyword") != "", F.col("search_keyword")))).alias("keywords"),
        F.array_sort(F.collect_set("click_category_id")).alias("categories"),
        format_time(start).alias("start_time"),
        (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("visit_length"),
        F.count(F.lit(1)).alias("step_length"),
    )


def session_profiles(sessions: DataFrame, users: DataFrame, strategy: str = "auto") -> DataFrame:
    """Sessions with their user; those without one drop out. ``broadcast`` sends users if they are few."""
    own = users.select("user_id", "age", "professional", "city", "sex")
    return bounded_join(sessions, own, "user_id") if strategy == "broadcast" else sessions.join(own, "user_id")


def filter_sessions(profiles: DataFrame, params: dict[str, list[str]]) -> DataFrame:
    """Age range, professions, cities, sex, keywords and categories; a missing parameter passes all."""
    age = [int(x) if (x := param(params, n)) else None for n in ("startAge", "endAge")]
    conditions = [
        opt_between("age", *age),
        opt_overlaps("professional", param_list(params, "professionals"), array=False),
        opt_overlaps("city", param_list(params, "cities"), array=False),
        opt_equal("sex", param(params, "sex")),
        opt_overlaps("keywords", param_list(params, "keywords")),
        opt_overlaps("categories", [int(x) for x in param_list(params, "categoryIds")]),
    ]
    return profiles.where(reduce(and_, conditions))


def session_stats(sessions: DataFrame) -> DataFrame:
    """One row: sessions, and how many are in each visit-length and step bucket."""

    def count(column: str, lo: int, hi: int | None):
        inside = F.col(column) >= lo if hi is None else F.col(column).between(lo, hi)
        return F.coalesce(F.sum(inside.cast("long")), F.lit(0))

    visits = [count("visit_length", lo, hi).alias(f"visit_{n}") for n, lo, hi in VISIT_BUCKETS]
    steps = [count("step_length", lo, hi).alias(f"step_{n}") for n, lo, hi in STEP_BUCKETS]
    return sessions.agg(F.count(F.lit(1)).alias("session_count"), *visits, *steps)


def session_ratios(stats: DataFrame, scale: int | None = 2) -> DataFrame:
    """Buckets as shares of all sessions; null without sessions."""
    names = [c for c in stats.columns if c != "session_count"]
    return stats.select("session_count", *[ratio(c, "session_count", scale).alias(f"{c}_ratio") for c in names])


def sessions_per_hour(sessions: DataFrame) -> DataFrame:
    """Sessions of each hour of a day, and of the day."""
    hours = sessions.groupBy(date_hour("start_time").alias("date_hour")).agg(F.count(F.lit(1)).alias("n"))
    day = F.substring("date_hour", 1, 10)
    return hours.withColumn("day_n", F.sum("n").over(Window.partitionBy(day)))


def extract_sessions(sessions: DataFrame, total: int = 100, seed: str = "0") -> DataFrame:
    """A repeatable stratified sample: equal quotas for days, shared among a day's hours by their counts.

    Ranks come from a hash, so only the quota's smallest hashes of an hour are looked at.
    """
    hours = sessions_per_hour(sessions).withColumn("date", F.substring("date_hour", 1, 10))
    days = hours.agg(F.count_distinct("date")).scalar()
    quota = F.floor(F.col("n") / F.col("day_n") * F.floor(F.lit(total) / days))
    quotas = hours.select("date_hour", F.least(quota, "n").alias("quota"))
    order = Window.partitionBy("date_hour").orderBy(F.md5(F.concat(F.lit(f"{seed}_"), "session_id")), "session_id")
    ranked = sessions.withColumn("date_hour", date_hour("start_time")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= total)
    return ranked.join(quotas, "date_hour").where("rank <= quota").drop("rank", "quota")


def session_details(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions of the given sessions."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi")


def to_session_detail(details: DataFrame, task_id: int) -> DataFrame:
    names = ["user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids"]
    return details.select(F.lit(task_id).cast("long").alias("task_id"), *names)


def filter_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a filter, as one row each."""
    return before.agg(F.lit("before").alias("step"), F.count(F.lit(1)).alias("n")).unionByName(after.agg(F.lit("after").alias("step"), F.count(F.lit(1)).alias("n")))
