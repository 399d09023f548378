"""Joins and aggregations for skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if its estimated size is at most this.
BROADCAST_BYTES = 64 << 20


def size_estimate(df: DataFrame) -> int:
    """Spark's own upper estimate of a frame's bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def few_rows(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a frame has so few rows; counted, for frames of which Spark has no estimate."""
    return df.limit(most + 1).count() <= most


def bounded_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Sends ``right`` to all executors if it is small; else a plain join, which Spark plans."""
    return left.join(F.broadcast(right) if size_estimate(right) <= bound else right, on, how)


def hot_keys(df: DataFrame, key: str, share: float = 0.1, fraction: float = 0.1, seed: int = 9) -> list:
    """Keys that hold about ``share`` of the rows or more, from a sample: 1 / share keys at most.

    They come to the driver, so that all uses see the same keys; a sample drawn anew may differ.
    """
    sample = df.select(key).where(F.col(key).isNotNull()).sample(False, fraction, seed)
    most = int(1 / share) + 1
    counts = sample.groupBy(key).count().orderBy(F.desc("count"), key)
    # of keys below these none can have the share
    total, found = sample.count(), counts.limit(most).collect()
    return [r[key] for r in found if r["count"] >= share * total]


def skew_split_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """Inner join with the hottest keys joined apart, salted; the rest is a plain join."""
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on)
    is_hot = F.col(on).isin(hot)
    return salted_join(left.where(is_hot), right.where(is_hot), on, salts).unionByName(left.where(~is_hot).join(right, on))


def salted_join(left: DataFrame, right: DataFrame, on: str, n: int = 10) -> DataFrame:
    """Inner join of a left side dealt into ``n`` parts per key with ``n`` copies of the right side."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.withColumn("_salt", salt).join(copies, ["_salt", on]).drop("_salt")


def salted_count(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Rows per key in two steps: per key and salt, then per key."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(n)).alias("_salt")
    return df.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("n"))
