"""A table's initial snapshot spliced with its changes (SRC-7).

The snapshot is read in chunks (key ranges) while changes arrive. A chunk's rows are read between two positions
of the change log, low and high. They are brought in only when all changes up to high have been, and count as
rows of the position low: a key that a change of the meantime has touched keeps that change, deletions included,
and any other key's row was the same all that time. So no row ever gets older, whatever the order in which
chunks and changes come.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import BUCKETS, exists, names_in, read_dim, read_mark, remove, upsert_dim, write_mark
from .streams import batch_name, run_batches


def _seen(spark: SparkSession, work: str) -> int | None:
    found = [int(n) for n in names_in(spark, f"{work}/seen") if n.lstrip("-").isdigit()]
    return max(found) if found else None


def _note_seen(spark: SparkSession, work: str, position: int) -> None:
    """Only ever forward; a repeated batch notes the same."""
    before = names_in(spark, f"{work}/seen")
    write_mark(spark, f"{work}/seen/{max(position, _seen(spark, work) or position)}")
    top = str(_seen(spark, work))
    for name in before:
        if name != top:
            remove(spark, f"{work}/seen/{name}")


def _land_chunk(spark: SparkSession, work: str, k: int, read: Callable[[int], DataFrame | None], position: Callable[[], int]) -> dict | None:
    """Reads chunk ``k`` between two positions, once; None behind the last chunk."""
    mark = f"{work}/landed/{k}.json"
    if not exists(spark, mark):
        low = position()
        rows = read(k)
        if rows is None:
            return None
        rows.write.mode("overwrite").parquet(f"{work}/landed/{k}")
        write_mark(spark, mark, json.dumps({"low": low, "high": position()}))
    return json.loads(read_mark(spark, mark))


def _apply_chunks(spark: SparkSession, work: str, path: str, keys: list[str], read: Callable, position: Callable, buckets: int) -> int:
    """Brings in the chunks whose window the changes have passed; returns how many are in by now."""
    while True:
        k = len(names_in(spark, f"{work}/applied"))
        chunk = _land_chunk(spark, work, k, read, position)
        seen = _seen(spark, work)
        if chunk is None or (chunk["high"] > chunk["low"] and (seen is None or seen < chunk["high"])):
            return k
        rows = spark.read.parquet(f"{work}/landed/{k}").withColumn("type", F.lit("read")).withColumn("position", F.lit(chunk["low"]).cast("long"))
        upsert_dim(rows.withColumn("change", F.lit(False)), path, keys, ["position", "change"], f"{k},snapshot", buckets)
        write_mark(spark, f"{work}/applied/{k}")
        remove(spark, f"{work}/landed/{k}")


def splice_stream(changes: DataFrame, read: Callable[[int], DataFrame | None], position: Callable[[], int], path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Keeps a copy of a table from its changes and a snapshot; returns how many chunks are in.

    ``changes`` has the table's columns, type and position; ``read(k)`` gives the rows of the k-th key range,
    or None behind the last; ``position()`` is the end of the change log at that moment. Chunks are read
    beside the changes: after each batch, those whose window has passed are brought in, and the next one is
    read. A chunk waits for changes (of any table of the log, such as a heartbeat) up to its high position; a
    stream that ends before leaves it for the next run. Changes from the first low position on must come.
    """
    work, checkpoint = f"{path}-splice", f"{path}-splice/_checkpoint"
    spark = changes.sparkSession
    order = ["position", "change"]

    def each(batch: DataFrame, batch_id: int) -> None:
        own = batch.withColumn("change", F.lit(True)).persist()
        upsert_dim(own, path, keys, order, batch_name(batch.sparkSession, checkpoint, batch_id), buckets)
        top = own.agg(F.max("position")).first()[0]
        own.unpersist()
        if top is not None:
            _note_seen(batch.sparkSession, work, top)
        _apply_chunks(batch.sparkSession, work, path, keys, read, position, buckets)

    _land_chunk(spark, work, len(names_in(spark, f"{work}/applied")), read, position)  # the first low position comes before all changes
    run_batches(changes, each, checkpoint)
    return _apply_chunks(spark, work, path, keys, read, position, buckets)


def read_spliced(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the copy; keys whose last change is a deletion are remembered, but not shown."""
    return read_dim(spark, path).where("type != 'delete'").drop("type", "position", "change")
