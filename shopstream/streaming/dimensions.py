"""Keyed dimension tables in hash buckets (SNK-7): a batch reads and replaces only the buckets of its keys.

A table's folder has ``data/bucket=N`` and its settings (keys, number of buckets, columns). The new contents
of the buckets that a batch touches are first written aside; once they are complete, they are moved to
the places of the old ones, so a driver that dies meanwhile loses nothing: the next batch, or the same one again,
ends the work, and readers take the buckets concerned from what was written aside.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cdc

#: Buckets of a new table: choose them so that a bucket's rows fit well into a task; ``rebucket`` changes them.
BUCKETS = 32
_BUCKET = "_bucket"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, which may be missing."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, place = _place(spark, path)
    _, last = _place(spark, to)
    fs.mkdirs(last.getParent())
    if not fs.rename(place, last):
        raise OSError(f"{path} can't be moved to {to}")


def write_mark(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file that is there as a whole or not at all: it is written under another name first."""
    fs, place = _place(spark, f"{path}.tmp")
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, last = _place(spark, path)
    fs.delete(last, False)
    fs.rename(place, last)


def read_mark(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _settings(spark: SparkSession, path: str) -> dict | None:
    """The newest settings; those before stay until they are replaced."""
    found = [int(n[10:]) for n in names_in(spark, path) if n.startswith("_settings-") and n[10:].isdigit()]
    return json.loads(read_mark(spark, f"{path}/_settings-{max(found)}")) | {"version": max(found)} if found else None


def _store(spark: SparkSession, path: str, keys: list[str], buckets: int, schema: T.StructType, before: dict | None) -> dict:
    version = before["version"] + 1 if before else 0
    own = {"keys": keys, "buckets": buckets, "schema": schema.jsonValue()}
    write_mark(spark, f"{path}/_settings-{version}", json.dumps(own))
    if before:
        remove(spark, f"{path}/_settings-{before['version']}")
    return own | {"version": version}


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _schema(settings: dict) -> T.StructType:
    return T.StructType.fromJson(settings["schema"])


def _data(spark: SparkSession, path: str, settings: dict, folder: str) -> DataFrame:
    schema = T.StructType([*_schema(settings).fields, T.StructField(_BUCKET, T.IntegerType())])
    if not exists(spark, f"{path}/{folder}"):
        return spark.createDataFrame([], schema)
    # each read has a name of its own: buckets are moved, so Spark doesn't see that rows it caches of an equal read are old
    return spark.read.schema(schema).option("read", uuid.uuid4().hex).parquet(f"{path}/{folder}")


def _pending(spark: SparkSession, path: str) -> list[str]:
    """Names of batches whose buckets are written aside, but not taken over."""
    return [n for n in names_in(spark, f"{path}/_pending") if exists(spark, f"{path}/_pending/{n}/_SUCCESS")]


def _buckets_of(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split("=")[1]) for n in names_in(spark, path) if n.startswith(f"{_BUCKET}=")]


def _rows(spark: SparkSession, path: str, settings: dict, touched: list[int] | None = None) -> DataFrame:
    """Rows with their bucket; buckets that are written aside are read there."""
    out = _data(spark, path, settings, "data")
    for name in _pending(spark, path):
        new = _buckets_of(spark, f"{path}/_pending/{name}")
        out = out.where(~F.col(_BUCKET).isin(new)).unionByName(_data(spark, path, settings, f"_pending/{name}"))
    return out if touched is None else out.where(F.col(_BUCKET).isin(touched))


def read_dim(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a dimension, or None if there is none; a plain Parquet folder counts, too."""
    settings = _settings(spark, path)
    if settings is None:
        return spark.read.parquet(path) if names_in(spark, path) else None
    return _rows(spark, path, settings).drop(_BUCKET)


def _take_over(spark: SparkSession, path: str, settings: dict) -> None:
    """Moves buckets that are written aside to their places, one by one; what is left there still counts for readers."""
    for name in _pending(spark, path):
        aside = f"{path}/_pending/{name}"
        for bucket in _buckets_of(spark, aside):
            own = f"{path}/data/{_BUCKET}={bucket}"
            remove(spark, own)
            move(spark, f"{aside}/{_BUCKET}={bucket}", own)
        _done(spark, path, name)
        remove(spark, aside)


def _done(spark: SparkSession, path: str, name: str) -> None:
    """Notes the batch; of each stream only the last one is remembered."""
    write_mark(spark, f"{path}/_batches/{name}")
    for other in names_in(spark, f"{path}/_batches"):
        if other != name and other.partition(",")[2] == name.partition(",")[2]:
            remove(spark, f"{path}/_batches/{other}")


def upsert_dim(batch: DataFrame, path: str, keys: list[str], order: list[str], name: str, buckets: int = BUCKETS) -> int:
    """Brings a batch into a dimension: of each key the last row in ``order``. Returns how many buckets it replaced.

    ``name`` (number, then the stream's id) tells the batch from all others, those of an earlier run of the
    stream, too (``batch_name``); a repeated batch changes nothing. Buckets without a key of the batch are
    neither read nor written. ``buckets`` counts for a new table only. New columns are added, null in the
    rows before. One batch at a time may write to a table.
    """
    spark = batch.sparkSession
    settings = _settings(spark, path)
    if settings is not None and settings["keys"] != keys:
        raise ValueError(f"{path} has the keys {settings['keys']}, not {keys}")
    if settings is not None:
        _take_over(spark, path, settings)
    if exists(spark, f"{path}/_batches/{name}"):
        return 0
    fields = {f.name: f for f in (_schema(settings).fields if settings else [])}
    new = [T.StructField(f.name, f.dataType) for f in batch.schema.fields if f.name not in fields]
    if settings is None or new:
        schema = T.StructType([*fields.values(), *new])
        settings = _store(spark, path, keys, settings["buckets"] if settings else buckets, schema, settings)
    own = cdc.latest_per_key(batch, keys, order).withColumn(_BUCKET, _bucket(keys, settings["buckets"])).persist()
    try:
        touched = [r[0] for r in own.select(_BUCKET).distinct().collect()]  # as many as the table has buckets at most
        if touched:
            # brought together by bucket, so each is one file and its keys are grouped where they are
            rows = _rows(spark, path, settings, touched).unionByName(own, allowMissingColumns=True).repartition(_BUCKET)
            old = set(touched) & set(_buckets_of(spark, f"{path}/data"))  # without any, keys are unique by now
            merged = cdc.latest_per_key(rows, [_BUCKET, *keys], order) if old else rows
            merged.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/_pending/{name}")
            _take_over(spark, path, settings)
        else:
            _done(spark, path, name)
    finally:
        own.unpersist()
    return len(touched)


def rebucket(spark: SparkSession, path: str, to: str, buckets: int) -> None:
    """Writes a dimension into a new folder with another number of buckets."""
    settings = _settings(spark, path)
    rows = _rows(spark, path, settings).drop(_BUCKET).withColumn(_BUCKET, _bucket(settings["keys"], buckets))
    rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{to}/data")
    _store(spark, to, settings["keys"], buckets, _schema(settings), None)


def read_keys(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the given keys; only their buckets are read. Their buckets come to the driver, not the keys."""
    settings = _settings(spark, path)
    names = settings["keys"]
    touched = [r[0] for r in keys.select(_bucket(names, settings["buckets"]).alias("b")).distinct().collect()]
    own = _rows(spark, path, settings, touched).drop(_BUCKET)
    match = reduce(lambda a, b: a & b, [own[k].eqNullSafe(keys[k]) for k in names])
    return own.join(keys.select(names).distinct(), match, "left_semi") if touched else own
