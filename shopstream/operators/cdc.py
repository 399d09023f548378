"""Change records: envelope, routing by configuration, latest state of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsons import project_json
from .skew import bounded_join, few_rows

ENVELOPE = "struct<database:string,tableName:string,before:map<string,string>,after:map<string,string>,type:string,position:bigint>"


#: The same with fields of any type.
TYPED = ENVELOPE.replace("map<string,string>", "map<string,variant>")
#: The sink type of dimension tables.
KEYED = "hbase"


def cdc_db(topic: str) -> Column:
    return F.get(F.split(topic, r"\."), F.lit(1))


def cdc_table(topic: str) -> Column:
    return F.get(F.split(topic, r"\."), F.lit(2))


def cdc_op(op: str) -> Column:
    """Lower case; create is called insert."""
    return F.when(F.lower(op) == "create", "insert").otherwise(F.lower(op))


def _position(rows: DataFrame) -> list[str]:
    """The place of a change among those of its table, if the source tells it."""
    return ["position"] if "position" in rows.columns else []


def normalize_cdc(raw: DataFrame) -> DataFrame:
    """(topic, op, before, after) to database, tableName, before, after, type; a position stays."""
    side = lambda c: F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(raw.schema[c].dataType.valueType)))).alias(c)
    return raw.select(cdc_db("topic").alias("database"), cdc_table("topic").alias("tableName"), side("before"), side("after"), cdc_op("op").alias("type"), *_position(raw))


def to_envelope(cdc: DataFrame) -> DataFrame:
    return cdc.select(F.to_json(F.struct("database", "tableName", "before", "after", "type", *_position(cdc))).alias("value"))


def parse_envelopes(lines: DataFrame, value: str = "value", typed: bool = False) -> DataFrame:
    """Adds ``e``, the envelope of a line; null for what is none, is cut off or names no table.

    Fields are text, or with ``typed`` variants, so that numbers and nested values stay what they are.
    """
    kind = TYPED if typed else ENVELOPE
    parsed = F.from_json(F.col(value), f"{kind[:-1]},broken:string>", {"columnNameOfCorruptRecord": "broken"})
    whole = F.col("_e.broken").isNull() & F.col("_e.tableName").isNotNull()
    return lines.withColumn("_e", parsed).withColumn("e", F.when(whole, F.col("_e").dropFields("broken"))).drop("_e")


def from_envelope(lines: DataFrame, value: str = "value", typed: bool = False) -> DataFrame:
    return parse_envelopes(lines, value, typed).where("e is not null").select("e.*")


def of_tables(cdc: DataFrame, tables: list[str] | None) -> DataFrame:
    """Records of tables named ``database.table``; all without names."""
    return cdc.where(F.concat_ws(".", "database", "tableName").isin(tables)) if tables else cdc


def drop_deletes(cdc: DataFrame) -> DataFrame:
    """A missing type passes."""
    return cdc.where(~F.col("type").eqNullSafe("delete"))


def latest_config(changes: DataFrame, order: str) -> DataFrame:
    """The last row of each (source_table, operate_type) in order; deleted ones are gone."""
    own = Window.partitionBy("source_table", "operate_type").orderBy(F.desc(order))
    return changes.withColumn("_rank", F.row_number().over(own)).where("_rank = 1 and type != 'delete'").drop("_rank")


_KEY = ["source_table", "operate_type"]


def one_rule_a_key(config: DataFrame) -> DataFrame:
    """A rule for each (source_table, operate_type); two different ones are an error, as nothing tells which counts."""
    rest = F.struct(*[c for c in config.columns if c not in _KEY])
    two = F.raise_error(F.concat(F.lit("two rules for "), F.coalesce("source_table", F.lit("null")), F.lit(", "), F.coalesce("operate_type", F.lit("null"))))
    own = config.groupBy(*_KEY).agg(F.min(rest).alias("a"), F.max(rest).alias("b"))
    return own.select(*_KEY, F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(two.cast(own.schema["a"].dataType)).alias("a")).select(*_KEY, "a.*")


def rule_versions(changes: DataFrame) -> DataFrame:
    """Changes of the configuration, with type and position, as versions: a rule holds in [since, until).

    Of changes of a key at one position the greatest counts. A deletion is a version, too (``gone``); before
    its first version a key has no rule, and the last version holds for ever.
    """
    rest = F.struct(*[c for c in changes.columns if c not in [*_KEY, "position"]])
    own = changes.where("position is not null").groupBy(*_KEY, "position").agg(F.max(rest).alias("r"))
    # a rule's versions are as many as its changes were: few
    order = Window.partitionBy(*_KEY).orderBy("position")
    own = own.withColumn("until", F.lead("position").over(order)).select(*_KEY, F.col("position").alias("since"), "until", "r.*")
    return own.withColumn("gone", F.coalesce(F.col("type") == "delete", F.lit(False)))


def route_cdc(cdc: DataFrame, config: DataFrame) -> DataFrame:
    """Adds sink_type, sink_table, sink_pk, key and payload, the wanted fields; nulls where nothing is configured.

    ``config`` is a rule a key, or the versions of ``rule_versions``: then a record gets the rule that was in
    force at its position, and the newest one if it has no position. The key is taken from the record, and put
    into the payload of a record for a keyed sink if the rule leaves it out.
    """
    dated = "since" in config.columns
    rules = config.where("not gone") if dated else one_rule_a_key(config)
    # a plain join would bring all changes of a table and type into one task
    small = F.broadcast if few_rows(config) else lambda df: df
    named = [F.col("source_table").alias("tableName"), F.col("operate_type").alias("type"), "sink_type", "sink_table", "sink_columns", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk")]
    if dated:
        rules = rules.select(F.col("source_table").alias("_table"), F.col("operate_type").alias("_type"), *named[2:], "since", "until")
        at = F.col("position") if "position" in cdc.columns else F.lit(None).cast("long")
        in_force = F.when(at.isNull(), F.col("until").isNull()).otherwise((at >= F.col("since")) & (F.col("until").isNull() | (at < F.col("until"))))
        rows = cdc.join(small(rules), (F.col("tableName") == F.col("_table")) & (F.col("type") == F.col("_type")) & in_force, "left").drop("_table", "_type", "since", "until")
    else:
        rows = cdc.join(small(rules.select(*named)), ["tableName", "type"], "left")
    key = F.element_at("after", F.col("sink_pk"))
    payload = project_json("after", "sink_columns")
    keyed = F.map_concat(F.map_filter(payload, lambda k, _: k != F.col("sink_pk")), F.map_from_arrays(F.array(F.coalesce("sink_pk", F.lit("id"))), F.array(key)))
    whole = F.when((F.col("sink_type") == KEYED) & key.isNotNull(), keyed).otherwise(payload)
    return rows.withColumn("key", key.cast("string")).withColumn("payload", whole).drop("sink_columns")


def unmatched(rows: DataFrame) -> DataFrame:
    return rows.where("sink_type is null")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; grouped, so nothing is sorted and a key's rows are reduced where they are."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(rows.columns)


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert as a table: of each key the last row of both."""
    return latest_per_key(old.unionByName(new, allowMissingColumns=True), keys, order)


def lookup_dim(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Adds a dimension's columns; nulls where the key is unknown."""
    return bounded_join(rows, dim, key, "left")
