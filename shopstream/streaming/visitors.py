"""First-seen repair on a stream: only a device's first ``is_new`` log keeps the flag (ST-2, ST-3).

Which devices were seen is the state of a stream operator, kept and expired by Spark's state store. It is fed
with one row a device and batch, the device's first candidate, reduced where the rows are; so the rows of a
busy device neither come together nor pass through the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs
from . import streams
from .dimensions import exists


def _first_seen(spark, root: str, ttl: str | None, seen: str) -> dict:
    """Devices among the candidates written so far that the state doesn't know go to ``seen``; returns the state's progress."""
    kind = spark.read.parquet(f"{root}/candidates").schema
    rows = spark.readStream.schema(kind).parquet(f"{root}/candidates")
    new = rows.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["mid"]) if ttl else rows.dropDuplicates(["mid"])
    # a run may end with a batch without rows, which moves the watermark on
    query = streams.run_batches(new, lambda df, k: df.write.mode("overwrite").parquet(f"{seen}/state={k}"), f"{root}/_state")
    last = [s for p in query.recentProgress for s in p["stateOperators"]]
    return dict(last[-1]) if last else {}


def fix_is_new_stream(rows: DataFrame, order: list[str], root: str, ttl: str | None = None) -> list[dict]:
    """Writes the repaired rows of each batch into ``root``/rows; ``rows`` has mid and is_new, among others.

    Returns the progress of the state operator after each batch (``numRowsTotal`` are the devices it knows).
    With ``ttl`` (like ``30 days``) a device that was not first seen within that time is forgotten. A batch
    that is repeated finds its candidates written, so the state gets them once, and its devices in ``seen``.
    """
    mid, is_new = F.col("mid"), F.col("is_new")
    progress: list[dict] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        candidates, seen = f"{root}/candidates/batch={batch_id}", f"{root}/seen/batch={batch_id}"
        if not exists(spark, f"{candidates}/_SUCCESS"):
            first = logs.first_new(batch, mid, is_new, order).select(F.col("_mid").alias("mid"), F.col("_first").alias("first"), F.current_timestamp().alias("at"))
            first.write.mode("overwrite").parquet(candidates)
        progress.append(_first_seen(spark, root, ttl, seen))
        new = spark.read.parquet(seen) if exists(spark, seen) else spark.read.parquet(candidates).limit(0)
        fixed = logs.repeated_new(batch, new.select(F.col("mid").alias("_mid"), F.col("first").alias("_first")), mid, is_new, order)
        fixed = fixed.withColumn("is_new", F.when(F.col("_repeated"), "0").otherwise(is_new)).select(batch.columns)
        streams.write_batch(fixed, f"{root}/rows", batch_id)

    streams.run_batches(rows, each, f"{root}/_checkpoint")
    return progress


def flat_logs(parsed: DataFrame) -> DataFrame:
    """mid and is_new beside what the rest of a log needs."""
    return parsed.select(F.col("log.common.mid").alias("mid"), F.col("log.common.is_new").alias("is_new"), "event_id", "ts")
