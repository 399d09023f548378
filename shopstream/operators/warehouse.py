"""Warehouse loads: table specifications, daily increments, landing files, partition overwrite."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_of


@dataclass(frozen=True)
class OdsTable:
    """strategy: F full snapshot, I increments, U increments with updates, O once (no day partitions)."""

    strategy: str
    dates: tuple[str, ...]
    columns: dict[str, str] = field(hash=False)

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in self.columns.items()))


def _table(strategy: str, dates: str, columns: str, **types: str) -> OdsTable:
    return OdsTable(strategy, tuple(dates.split()), {c: types.get(c, "string") for c in columns.split()})


_D10, _D16 = "decimal(10,2)", "decimal(16,2)"
# Source tables with the date columns of their increments, their columns and types.
ODS_SPECS = {
    "order_info": _table("U", "create_time operate_time", "id final_total_amount order_status user_id out_trade_no create_time operate_time province_id benefit_reduce_amount original_total_amount feight_fee", final_total_amount=_D10, benefit_reduce_amount=_D10, original_total_amount=_D10, feight_fee=_D10),
    "order_detail": _table("I", "create_time", "id order_id user_id sku_id sku_name order_price sku_num create_time", order_price=_D10, sku_num="bigint"),
    "sku_info": _table("F", "", "id spu_id price sku_name sku_desc weight tm_id category3_id create_time", price=_D10),
    "user_info": _table("U", "create_time operate_time", "id name birthday gender email user_level create_time operate_time"),
    "base_category1": _table("F", "", "id name"),
    "base_category2": _table("F", "", "id name category1_id"),
    "base_category3": _table("F", "", "id name category2_id"),
    "payment_info": _table("I", "payment_time", "id out_trade_no order_id user_id alipay_trade_no total_amount subject payment_type payment_time", id="bigint", total_amount=_D16),
    "base_province": _table("O", "", "id name region_id area_code iso_code", id="bigint"),
    "base_region": _table("O", "", "id region_name", id="bigint"),
    "base_trademark": _table("F", "", "tm_id tm_name", tm_id="bigint"),
    "order_status_log": _table("I", "operate_time", "id order_id order_status operate_time", id="bigint"),
    "spu_info": _table("F", "", "id spu_name category3_id tm_id"),
    "comment_info": _table("I", "create_time", "id user_id sku_id spu_id order_id appraise create_time"),
    "order_refund_info": _table("I", "create_time", "id user_id order_id sku_id refund_type refund_num refund_amount refund_reason_type create_time", refund_num="bigint", refund_amount=_D16),
    "cart_info": _table("F", "", "id user_id sku_id cart_price sku_num sku_name create_time operate_time is_ordered order_time"),
    "favor_info": _table("F", "", "id user_id sku_id spu_id is_cancel create_time cancel_time"),
    "coupon_use": _table("U", "get_time using_time used_time", "id coupon_id user_id order_id coupon_status get_time using_time used_time"),
    "coupon_info": _table("F", "", "id coupon_name coupon_type condition_amount condition_num activity_id benefit_amount benefit_discount create_time range_type spu_id tm_id category3_id limit_num operate_time expire_time"),
    "activity_info": _table("F", "", "id activity_name activity_type start_time end_time create_time"),
    "activity_order": _table("I", "create_time", "id activity_id order_id create_time"),
    "activity_rule": _table("F", "", "id activity_id condition_amount condition_num benefit_amount benefit_discount benefit_level"),
    "base_dic": _table("F", "", "dic_code dic_name parent_code create_time operate_time"),
}


def on_day(column: str, day: str) -> Column:
    return F.coalesce(F.try_to_timestamp(F.col(column)).cast("date") == F.lit(day).cast("date"), F.lit(False))


def increment(df: DataFrame, day: str, dates: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows with any of the dates on the day; all rows without dates."""
    return df.where(any_of([on_day(c, day) for c in dates])) if dates else df


def conform(df: DataFrame, spec: OdsTable) -> DataFrame:
    """The table's columns by name and type; missing ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in spec.columns.items()])


def import_order_detail(details: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with their order's user."""
    return details.join(orders.select(F.col("id").alias("order_id"), "user_id"), "order_id")


#: Characters that landing files can't hold as they are, and what stands for them; the backslash first.
_ESCAPES = [(b"\\", b"\\\\"), (b"\t", b"\\t"), (b"\n", b"\\n"), (b"\r", b"\\r")]
_NULL = "\\N"
_BACKSLASH = ord("\\")
#: The byte that a byte stands for behind a backslash (0: none).
_MEANS = np.zeros(256, np.uint8)
for _raw, _written in _ESCAPES:
    _MEANS[_written[1]] = _raw[0]
#: A byte that no text has.
_GONE = 255
#: Bytes of fields that are worked on at a time.
_BLOCK = 1 << 26


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.Buffer]:
    """Where the texts begin and end, and their bytes one after another."""
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return at - at[0], (data or pa.py_buffer(b""))[int(at[0]) : int(at[-1])]


def _texts(at: np.ndarray, data, present: np.ndarray | None = None) -> pa.StringArray:
    mask = None if present is None else pa.py_buffer(np.packbits(present, bitorder="little"))
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data), mask)


def _escaped(fields: pa.StringArray) -> pa.StringArray:
    at, data = _bytes_of(fields)
    bytes_ = np.frombuffer(data, np.uint8)
    special = np.zeros(len(data) + 1, bool)
    out = data.to_pybytes()
    for raw, written in _ESCAPES:
        if raw in out:
            special[1:] |= bytes_ == raw[0]
            out = out.replace(raw, written)
    if special.any():
        at, data = at + np.cumsum(special, dtype=np.int32)[at], out
    return _texts(at, data, fields.is_valid().to_numpy(zero_copy_only=False)).fill_null(_NULL)


def _unescaped(fields: pa.StringArray) -> pa.StringArray:
    """A backslash with a sign that it doesn't belong to stays; so does one that ends a field."""
    at, data = _bytes_of(fields)
    raw = np.frombuffer(data, np.uint8)
    slashes = np.flatnonzero(raw == _BACKSLASH)
    if not len(slashes):
        return fields
    begins = np.zeros(len(raw) + 1, bool)  # of a field, or the end of the last one
    begins[at] = True
    apart = (np.diff(slashes, prepend=-2) != 1) | begins[slashes]
    runs = np.maximum.accumulate(slashes * apart)  # where its run of backslashes begins
    means = _MEANS[np.take(raw, slashes + 1, mode="clip")]
    escapes = ((slashes - runs) & 1 == 0) & (means > 0) & ~begins[slashes + 1]
    first = slashes[escapes]
    out, gone = raw.copy(), np.zeros(len(raw) + 1, bool)
    out[first], out[first + 1], gone[first + 1] = _GONE, means[escapes], True
    two = np.flatnonzero(np.diff(at) == 2)
    present = np.ones(len(fields), bool)
    present[two] = (raw[at[two]] != _BACKSLASH) | (raw[at[two] + 1] != ord(_NULL[1]))
    return _texts(at - np.cumsum(gone, dtype=np.int32)[at], out.tobytes().translate(None, bytes([_GONE])), present)


def _each_field(work: Callable[[pa.StringArray], pa.StringArray], join: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of fields with ``work`` done on all fields of a block at once; joined by tabs if asked for."""
    for batch in batches:
        step = max(1, batch.num_rows * _BLOCK // max(1, batch.nbytes))
        for k in range(0, batch.num_rows, step):
            rows = batch.column(0).slice(k, step)
            at = rows.offsets.to_numpy()
            out = pa.ListArray.from_arrays(at - at[0], work(rows.values.slice(at[0], at[-1] - at[0])))
            yield pa.RecordBatch.from_arrays([pc.binary_join(out, "\t") if join else out], ["value"])


def land(df: DataFrame, root: str, table: str, day: str) -> str:
    """Tab-separated landing files that keep every value; replaces what was there.

    Nulls are ``\\N``; tabs, line ends and backslashes in values are written as ``\\t``, ``\\n``, ``\\r`` and ``\\\\``,
    so a line is a row, and blanks, empty values and a literal ``\\N`` come back as they were.
    """
    path = f"{root}/{table}/{day}"
    # Spark's replace compares at every byte, four times a field; the bytes of many rows at once take a tenth of that
    fields = df.select(F.array(*[F.col(c).cast("string") for c in df.columns]).alias("value"))
    lines = fields.mapInArrow(partial(_each_field, _escaped, True), "value string")
    lines.write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip", lineSep="\n")
    return path


def read_landed(spark: SparkSession, root: str, table: str, day: str) -> DataFrame:
    """The rows of landing files by the table's columns; fields that a line lacks are null."""
    fields = spark.read.text(f"{root}/{table}/{day}", lineSep="\n").select(F.split("value", "\t", -1).alias("value"))
    found = fields.mapInArrow(partial(_each_field, _unescaped, False), "value array<string>")
    return found.select(*[F.get("value", F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(ODS_SPECS[table].columns.items())])


def overwrite_partition(df: DataFrame, path: str, column: str = "dt", value: str | None = None) -> None:
    """Replaces only the partitions that ``df`` has (or the one of ``value``)."""
    df = df if value is None else df.withColumn(column, F.lit(value))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _side_by_side(spark: SparkSession, names: list[str], work: Callable[[str], object], at_once: int) -> None:
    """Runs the tables' jobs at once, each in a scheduler pool of its own; waits for all and raises the first error."""

    def one(name: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        work(name)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(one), name) for name in names]:
            done.result()


def import_source(source: Callable[[str], DataFrame], root: str, mode: str, day: str, at_once: int = 8) -> list[str]:
    """Lands tables: all for ``first``, those that change for ``all``, or the one named. Full tables whole, others by day."""
    names = [n for n, s in ODS_SPECS.items() if mode == "first" or (mode == "all" and s.strategy != "O") or mode == n]

    def one(name: str) -> None:
        spec = ODS_SPECS[name]
        land(conform(increment(source(name), day, () if mode == "first" else spec.dates), spec), root, name, day)

    if names:
        _side_by_side(SparkSession.active(), names, one, at_once)
    return names


def load_ods(spark: SparkSession, root: str, warehouse: str, mode: str, day: str, at_once: int = 8) -> list[str]:
    """Loads landed files into day partitions, and the tables loaded once only for ``first``.

    All tables are read and typed into a staging folder first. Only when that has succeeded for every one of
    them do the new partitions take the places of the old, which are renames; so a table that fails leaves the
    former day of all of them. A run that ends between two renames is finished by the next run for the day.
    """
    names = [n for n, s in ODS_SPECS.items() if mode == "first" or s.strategy != "O"]
    staging = f"{warehouse}/_staging/{day}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    place = lambda path: hadoop.Path(path)
    if not fs.exists(place(f"{staging}/_ready")):
        fs.delete(place(staging), True)
        _side_by_side(spark, names, lambda name: read_landed(spark, root, name, day).write.mode("overwrite").parquet(f"{staging}/{name}"), at_once)
        fs.create(place(f"{staging}/_ready")).close()
    for name in names:
        path = f"{warehouse}/ods_{name}" + ("" if ODS_SPECS[name].strategy == "O" else f"/dt={day}")
        if fs.exists(place(f"{staging}/{name}")):
            fs.delete(place(path), True)
            fs.mkdirs(place(path).getParent())
            fs.rename(place(f"{staging}/{name}"), place(path))
    fs.delete(place(staging), True)
    return names


def create_ods(spark: SparkSession, database: str, warehouse: str) -> None:
    """External tables over the folders that ``load_ods`` fills."""
    spark.sql(f"create database if not exists {database}")
    for name, spec in ODS_SPECS.items():
        columns = ", ".join(f"{c} {t}" for c, t in spec.columns.items())
        day = "" if spec.strategy == "O" else "partitioned by (dt)"
        columns += "" if spec.strategy == "O" else ", dt string"
        spark.sql(f"create table if not exists {database}.ods_{name} ({columns}) using parquet {day} location '{warehouse}/ods_{name}'")
