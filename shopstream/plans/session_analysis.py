"""The session analysis job from actions to all its result tables (WH-5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import rankings, sessions
from ..sources.io import write_result


def session_analysis(actions: DataFrame, users: DataFrame, params: dict[str, list[str]], total: int = 100, n: int = 10) -> dict[str, DataFrame]:
    """Result tables by name."""
    return _results(_scan(actions, params), select_sessions(actions, users, params), total, n)


def _scan(actions: DataFrame, params: dict[str, list[str]]) -> DataFrame:
    return sessions.scan_actions(actions, *(v[0] if (v := params.get(k)) else None for k in ("startDate", "endDate")))


def select_sessions(actions: DataFrame, users: DataFrame, params: dict[str, list[str]]) -> DataFrame:
    """The sessions that all result tables are about."""
    return sessions.filter_sessions(sessions.session_profiles(sessions.aggregate_sessions(_scan(actions, params)), users), params)


def _results(own: DataFrame, kept: DataFrame, total: int, n: int) -> dict[str, DataFrame]:
    details = sessions.session_details(kept, own)
    stats = sessions.session_stats(kept)
    extracted = sessions.extract_sessions(kept, total)
    top = rankings.top_categories(rankings.category_counts(rankings.category_events(details)), n)
    best = rankings.top_sessions(rankings.session_category_clicks(details), top, n)
    return {
        "session_aggr_stat": sessions.session_ratios(stats),
        "session_random_extract": extracted,
        "session_detail": sessions.session_details(extracted, details),
        "top10_category": top,
        "top10_category_session": best.drop("rank"),
        "top10_session_detail": rankings.top_session_details(best, details),
    }


def run_session_analysis(actions: DataFrame, users: DataFrame, params: dict[str, list[str]], root: str, task_id: int, total: int = 100, n: int = 10, counts: dict[str, int] | None = None) -> list[str]:
    """Writes all result tables of a task and returns their names.

    The actions are read twice: for the sessions, and once for the actions of those that the filter keeps, which
    are written and serve all tables; tables that others build on are read back. ``counts`` gets the sessions
    before and after the filter, counted while the kept ones are written. What only this run reads is deleted.
    """
    spark = actions.sparkSession
    work = f"{root}/_work-{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    before, after = Observation("before"), Observation("after")
    one = F.count(F.lit(1)).alias("n")
    own = _scan(actions, params)
    profiles = sessions.session_profiles(sessions.aggregate_sessions(own), users).observe(before, one)
    kept = put(sessions.filter_sessions(profiles, params).observe(after, one), "kept")
    if counts is not None:
        counts |= {"before": before.get["n"], "after": after.get["n"]}
    details = put(sessions.session_details(kept, own), "details")
    extracted = put(sessions.extract_sessions(kept, total), "extracted")
    top = put(rankings.top_categories(rankings.category_counts(rankings.category_events(details)), n), "top")
    best = put(rankings.top_sessions(rankings.session_category_clicks(details), top, n), "best")
    results = {
        "session_aggr_stat": sessions.session_ratios(sessions.session_stats(kept)),
        "session_random_extract": extracted,
        "session_detail": sessions.session_details(extracted, details),
        "top10_category": top,
        "top10_category_session": best.drop("rank"),
        "top10_session_detail": rankings.top_session_details(best, details),
    }
    for name, rows in results.items():
        write_result(rows, f"{root}/{name}", task_id)
    place = spark._jvm.org.apache.hadoop.fs.Path(work)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return list(results)
