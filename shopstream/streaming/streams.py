"""Stream sources and idempotent batch sinks (SRC-4 to SRC-7, SRC-10, SNK-5, SNK-6, ST-10)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cdc
from .dimensions import exists, names_in, read_mark, remove, write_mark


def stream_options(topic: str, group: str, starting: str = "latest") -> dict[str, str]:
    """Options of a Kafka topic read by a group; ``initial`` is from the begin."""
    return {"subscribe": topic, "kafka.group.id": group, "startingOffsets": "earliest" if starting == "initial" else starting}


def read_stream(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    """Lines (column value): of a Kafka topic, or of text files as they come (``path``)."""
    if "path" in source:
        return spark.readStream.text(source["path"])
    servers = {"kafka.bootstrap.servers": source["servers"]}
    stream = spark.readStream.format("kafka").options(**servers, **stream_options(source["topic"], source["group"], source.get("starting", "latest")))
    return stream.load().selectExpr("cast(value as string) value")


def write_topic(df: DataFrame, servers: str, topic: str | None = None, batch: str | None = None, sink: str = "kafka") -> None:
    """Values of a batch to one topic, or each to that in its column ``topic``.

    A repeated batch is sent again; with ``batch`` each record carries that name in a header, by which a
    consumer tells the resend. ``sink`` is the writer, which takes the options and columns of Kafka's.
    """
    own = df.select("value", *([] if topic else ["topic"]))
    if batch is not None:
        own = own.withColumn("headers", F.array(F.struct(F.lit("batch").alias("key"), F.lit(batch).cast("binary").alias("value"))))
    writer = own.write.format(sink).mode("append").option("kafka.bootstrap.servers", servers)
    (writer.option("topic", topic) if topic else writer).save()


def stream_logs(spark: SparkSession, folder: str, most: int = 1_000) -> DataFrame:
    """Lines (column line) of the files of a log folder as they come, ``most`` files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", most).text(folder).withColumnRenamed("value", "line")


def read_cdc(spark: SparkSession, source: dict[str, str], tables: list[str] | None = None) -> DataFrame:
    """Change records of a captured stream: of a whole database, or of ``tables`` (``database.table``) only.

    ``source`` as in ``read_stream``: ``starting`` says whether a topic is read from its begin (``initial``)
    or from what comes next (``latest``); files are always read from the first one.
    """
    return cdc.of_tables(cdc.from_envelope(read_stream(spark, source)), tables)


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """A batch's number and its stream's id, which a stream keeps as long as it has its checkpoint."""
    return f"{batch_id},{json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch's rows in a folder of its own, so that a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def begin_batch(spark: SparkSession, root: str, batch_id: int, name: str) -> bool:
    """Whether this very batch was committed; the commit of another one with its number, of an earlier stream, is taken back."""
    mark = f"{root}/_commits/{batch_id}"
    if exists(spark, mark):
        if read_mark(spark, mark) == name:
            return True
        remove(spark, mark)
    return False


def commit_batch(spark: SparkSession, root: str, batch_id: int, name: str) -> None:
    """Says that all sinks of a batch below ``root`` are written: one small file, made at once."""
    write_mark(spark, f"{root}/_commits/{batch_id}", name)


def committed(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, f"{root}/_commits") if n.isdigit())


def read_committed(spark: SparkSession, root: str, sink: str, of: list[int] | None = None) -> DataFrame | None:
    """Rows of a sink, of committed batches only (those of ``of``, read before, so that several sinks show the same ones)."""
    path = f"{root}/{sink}"
    own = [k for k in (committed(spark, root) if of is None else of) if exists(spark, f"{path}/batch={k}")]
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={k}" for k in own]) if own else None


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Runs ``each`` on every batch; ``once`` works off what is there and ends."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
