"""Stream jobs: log split, CDC routing and dimension upserts (ST-1, ST-4 to ST-9, SNK-7, SNK-8)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc, logs
from .dimensions import BUCKETS, exists, read_dim, remove, upsert_dim
from .streams import batch_name, begin_batch, commit_batch, read_committed, run_batches, write_batch, write_topic


def split_logs(lines: DataFrame, root: str, line: str = "line") -> None:
    """Dirty, start, page and display logs of each batch into folders of ``root``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = logs.parse_logs(batch, line).persist()
        good = logs.clean(parsed)
        for name, rows in (("dirty", logs.dirty(parsed, line)), ("start", logs.starts(good)), ("page", logs.pages(good)), ("display", logs.displays(good))):
            write_batch(rows, f"{root}/{name}", batch_id)
        parsed.unpersist()

    run_batches(lines, each, f"{root}/_checkpoint")


def multiplex_logs(lines: DataFrame, root: str, line: str = "line") -> None:
    """Valid logs by topic."""
    run_batches(lines, lambda b, k: logs.tag_logs(logs.etl_logs(b, line), line).write.mode("overwrite").partitionBy("topic").parquet(f"{root}/topics/batch={k}"), f"{root}/_checkpoint")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], order: list[str], mode: str = "append") -> None:
    """Upserts every batch; in mode ``update`` of a grouped stream the groups that changed."""
    checkpoint = f"{path}-checkpoint"
    run_batches(rows, lambda b, k: upsert_dim(b, path, keys, order, batch_name(b.sparkSession, checkpoint, k)), checkpoint, mode=mode)


def config_stream(changes: DataFrame, path: str, order: str) -> None:
    """Keeps a routing configuration as a dimension table (ST-8): the last change of each (source_table, operate_type)."""
    upsert_stream(changes, path, ["source_table", "operate_type"], [order])


def config_history_stream(changes: DataFrame, path: str) -> None:
    """Keeps every change of the routing configuration (ST-8), so that each record finds the rule of its position."""
    run_batches(changes, lambda b, k: write_batch(b, f"{path}/changes", k), f"{path}/_checkpoint")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The rules that ``config_stream`` has seen and that no later change deleted."""
    return read_dim(spark, path).where("type != 'delete'")


def capture_stream(raw: DataFrame, out: str, tables: list[str] | None = None, kafka: dict[str, str] | None = None) -> None:
    """The capture job (ST-6): change records of a connector, normalised, into one sink as envelopes.

    ``raw`` has topic, op, before and after; ``tables`` (``database.table``) limits what is captured. The
    sink is the folder ``out``, or with ``kafka`` (servers and topic) a topic; ``out`` then holds the
    checkpoint only.
    """
    own = cdc.to_envelope(cdc.of_tables(cdc.normalize_cdc(raw), tables))
    sink = (lambda b, k: write_topic(b, kafka["servers"], kafka["topic"])) if kafka else (lambda b, k: b.write.mode("overwrite").text(f"{out}/envelopes/batch={k}"))
    run_batches(own, sink, f"{out}/_checkpoint")


def ensure_table(spark: SparkSession, database: str, table: str, columns: str, path: str) -> None:
    """A table of text columns for a configured sink, unless there is one."""
    own = ", ".join(f"`{c.strip()}` string" for c in columns.split(","))
    spark.sql(f"create table if not exists {database}.{table} ({own}) using parquet location '{path}'")


def _by_sink(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with their sink (dirty, unmatched, unrouted, kafka or ``cdc.KEYED``) and what it needs of them as text; deletions go."""
    parsed = cdc.parse_envelopes(lines, typed=True).select(F.col("value").alias("line"), F.col("e").isNull().alias("dirty"), "e.*")
    rows = cdc.route_cdc(cdc.drop_deletes(parsed), rules)
    other = ~F.col("sink_type").isin("kafka", cdc.KEYED) | ((F.col("sink_type") == cdc.KEYED) & F.col("key").isNull())
    sink = F.when(F.col("dirty"), "dirty").when(F.col("sink_type").isNull(), "unmatched").when(other, "unrouted").otherwise(F.col("sink_type"))
    value = F.when(F.col("dirty"), F.col("line")).when(F.col("sink_type").isNull(), F.to_json("after")).otherwise(F.to_json("payload"))
    return rows.select(sink.alias("sink"), "sink_type", "sink_table", "tableName", "type", "key", "position", value.alias("value"))


def _fold(spark: SparkSession, root: str, batch_id: int, name: str, buckets: int) -> None:
    """Brings a batch's changes of dimensions into their tables; the loop is over the sink tables of the batch."""
    path = f"{root}/changes/batch={batch_id}"
    changes = spark.read.parquet(path)
    for (table,) in changes.select("sink_table").distinct().collect():  # as many as the rules name
        own = changes.where(F.col("sink_table") == table).select("key", "value", F.lit(batch_id).alias("batch"), "position")
        upsert_dim(own, f"{root}/dim/{table}", ["key"], ["position", "batch", "value"], name, buckets)
    remove(spark, path)


def read_routed_dim(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A dimension of ``route_stream``: its table, with the changes of committed batches that aren't in it yet."""
    own = read_dim(spark, f"{root}/dim/{table}")
    more = read_committed(spark, root, "changes")
    more = None if more is None else more.where(F.col("sink_table") == table).select("key", "value", F.col("batch").cast("int").alias("batch"), "position")
    parts = [x for x in (own, more) if x is not None]
    if not parts:
        return spark.createDataFrame([], "key string, value string, batch int, position long")
    return own if more is None else cdc.latest_per_key(reduce(DataFrame.unionByName, parts), ["key"], ["position", "batch", "value"])


def route_stream(envelopes: DataFrame, config: Callable[[], DataFrame], root: str, servers: str | None = None, buckets: int = BUCKETS) -> None:
    """Routes change records by a configuration that is read anew for each batch.

    ``config`` gives one rule a key, or with a column ``position`` the changes of the rules: then each record is
    routed by the rule in force at its own position. Records for Kafka go out by sink table, to topics of
    ``servers`` if given (with the batch's name as a header), else to folders; those for dimensions are upserted
    by the key in the record. Nothing is lost: lines that are no envelope are kept in ``dirty``, what has no
    route in ``unmatched``, and what has a route to another sink, or to a dimension without a key, in
    ``unrouted``; fields keep their JSON types. Only deletions are left out, as the rules don't have them.

    Of a key's changes the one of the highest ``position`` wins; of records without one, that of the last batch,
    and in a batch the greatest value, as nothing else tells their order.

    A batch is committed once, after its last sink: ``read_committed`` and ``read_routed_dim`` show all of a
    batch or nothing of it. Changes of dimensions are a sink of their own, brought into the tables after that;
    a job that stops between finds them there.
    """
    checkpoint = f"{root}/_checkpoint"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = batch_name(spark, checkpoint, batch_id)
        if begin_batch(spark, root, batch_id, name):  # committed before: at most the tables lack it
            if exists(spark, f"{root}/changes/batch={batch_id}"):
                _fold(spark, root, batch_id, name, buckets)
            return
        rules = config()
        rules = cdc.rule_versions(rules) if "position" in rules.columns else rules
        rows = _by_sink(batch, rules).persist()  # texts only, as variants are many times as large
        own = lambda sink: rows.where(F.col("sink") == sink)
        try:
            write_batch(own("dirty").select("value"), f"{root}/dirty", batch_id)
            write_batch(own("unmatched").select("tableName", "type", F.col("value").alias("after")), f"{root}/unmatched", batch_id)
            write_batch(own("unrouted").select("sink_type", "sink_table", "value"), f"{root}/unrouted", batch_id)
            write_batch(own(cdc.KEYED).select("sink_table", "key", "value", "position"), f"{root}/changes", batch_id)
            topics = own("kafka").select("sink_table", "value")
            if servers:
                write_topic(topics.withColumnRenamed("sink_table", "topic"), servers, batch=name)
            else:
                topics.write.mode("overwrite").partitionBy("sink_table").parquet(f"{root}/kafka/batch={batch_id}")
            commit_batch(spark, root, batch_id, name)
            _fold(spark, root, batch_id, name, buckets)
        finally:
            rows.unpersist()

    run_batches(envelopes, each, checkpoint)
