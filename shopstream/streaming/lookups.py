"""Lookup of a dimension on a stream (JOIN-12): refreshed after a time to live, unknown keys wait for their row."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cdc
from .dimensions import exists, names_in, read_dim, read_mark, remove, write_mark
from .streams import run_batches

#: Parts that the bound on waiting rows is dealt to.
SALTS = 32


class RefreshedDim:
    """A dimension held for a time to live; then it is read anew."""

    def __init__(self, load: Callable[[], DataFrame], ttl_s: float = 86_400):
        self.load, self.ttl_s, self.at, self.held = load, ttl_s, 0.0, None

    def __call__(self) -> DataFrame:
        if self.held is None or time.monotonic() - self.at >= self.ttl_s:
            self.release()
            # marked, since Spark would take the rows that another one holds of an equal plan instead of reading
            self.held, self.at = self.load().withColumn("_held", F.lit(uuid.uuid4().hex)).persist(), time.monotonic()
        return self.held.drop("_held")

    def release(self) -> None:
        """Lets go of the rows; the next call reads them."""
        if self.held is not None:
            self.held.unpersist()
            self.held = None


def table_dim(spark: SparkSession, path: str, columns: list[str], ttl_s: float = 86_400) -> RefreshedDim:
    """A dimension kept by ``upsert_dim``."""
    return RefreshedDim(lambda: read_dim(spark, path).select(columns), ttl_s)


def _overflow(spark: SparkSession, root: str, batch_id: int, schema: T.StructType) -> tuple[int, DataFrame | None]:
    """The first folder of ``root``/overflow that counts after a batch, and the rows there."""
    mark = f"{root}/_batches/{batch_id}"
    since = int(read_mark(spark, mark)) if exists(spark, mark) else 0
    own = [f"{root}/overflow/batch={k}" for k in range(since, batch_id + 1) if exists(spark, f"{root}/overflow/batch={k}")]
    return since, spark.read.schema(schema).parquet(*own) if own else None


def lookup_stream(rows: DataFrame, dim: Callable[[], DataFrame], key: str, root: str, most_waiting: int = 1_000_000) -> list[dict[str, int]]:
    """Adds a dimension's columns to the rows of a stream; returns for each batch how many rows wait and how many more are left.

    Rows whose key the dimension has go to ``root``/found. Others wait in ``root``/waiting, and are looked up
    again with each batch, at most ``most_waiting`` of them. What goes beyond is kept in ``root``/overflow, of
    which a batch reads the keys only; as soon as the dimension has any of them, all these rows are looked up
    again, too. So no row stays without a dimension row that is there. A batch replaces its own folders and
    reads what the one before it left, so a repeated batch gives the same. A dimension has one row a key; null
    keys don't wait, they go to ``root``/found with nulls.
    """
    counts: list[dict[str, int]] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{root}/waiting/batch={batch_id - 1}"
        own = batch.withColumn("_since", F.lit(batch_id))
        if exists(spark, before):
            own = own.unionByName(spark.read.parquet(before))
        known = dim().withColumn("_known", F.lit(True))
        first, rest = _overflow(spark, root, batch_id - 1, own.schema)
        back = rest is not None and not rest.select(key).join(known.select(key), key, "left_semi").isEmpty()
        if back:
            own = own.unionByName(rest)
        looked = cdc.lookup_dim(own, known, key).persist()
        try:
            done = F.col("_known").isNotNull() | F.col(key).isNull()
            looked.where(done).drop("_known", "_since").write.mode("overwrite").parquet(f"{root}/found/batch={batch_id}")
            order = Window.partitionBy("_salt").orderBy("_since", F.xxhash64(*batch.columns))  # who waits longest goes on waiting
            open_ = looked.where(~done).select(own.columns).withColumn("_salt", F.pmod(F.xxhash64(*batch.columns), F.lit(SALTS)))
            ranked = open_.withColumn("_rank", F.row_number().over(order)).drop("_salt").persist()
            stays = F.col("_rank") <= max(1, most_waiting // SALTS)
            ranked.where(stays).drop("_rank").write.mode("overwrite").parquet(f"{root}/waiting/batch={batch_id}")
            ranked.where(~stays).drop("_rank").write.mode("overwrite").parquet(f"{root}/overflow/batch={batch_id}")
            n = ranked.agg(F.count_if(stays).alias("waiting"), F.count_if(~stays).alias("overflow")).first().asDict()
            counts.append(n | {"overflow": n["overflow"] + (0 if rest is None or back else rest.count())})
            ranked.unpersist()
            write_mark(spark, f"{root}/_batches/{batch_id}", str(batch_id if back else first))
            # a repeated batch reads the one before it
            remove(spark, f"{root}/waiting/batch={batch_id - 2}")
            remove(spark, f"{root}/_batches/{batch_id - 2}")
            for name in names_in(spark, f"{root}/overflow"):
                if name.startswith("batch=") and int(name.split("=")[1]) < first:
                    remove(spark, f"{root}/overflow/{name}")
        finally:
            looked.unpersist()

    run_batches(rows, each, f"{root}/_checkpoint")
    return counts


def read_looked_up(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the stream's whole batches so far: found ones, and those that wait, with nulls for the dimension."""
    last = max(int(n) for n in names_in(spark, f"{root}/_batches") if n.isdigit())
    out = spark.read.parquet(f"{root}/found").where(F.col("batch") <= last).drop("batch")
    waiting = spark.read.parquet(f"{root}/waiting/batch={last}")
    rest = _overflow(spark, root, last, waiting.schema)[1]
    for own in (waiting, rest):
        out = out if own is None else out.unionByName(own.drop("_since"), allowMissingColumns=True)
    return out
