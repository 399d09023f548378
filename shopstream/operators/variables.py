"""Decision logs to rows of variables (entity, attribute, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import json_merge, parse_json_obj
from ..functions.text import indexed_name, parse_kv_list


def merge_indexed_agg(idx: str, value: str) -> Column:
    """Aggregate: values of a group joined by ``|`` in order of their index."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))), lambda e: e["v"]), "|")


def parse_decisions(lines: DataFrame, line: str = "value") -> DataFrame:
    """Log lines to (apply_code, create_time, var_type, key, value); var_type is input or output.

    A line is a time of 19 characters and, from its first ``{``, one JSON object; others give no rows.
    Keys like ``x[2]`` belong to a base ``x``, whose values are joined by ``|`` in order of the index; of
    entries with one index the last counts; null values are skipped.
    """
    # a column of its own for each step, so that nothing is computed twice
    rows = lines.select(F.substring(line, 1, 19).alias("create_time"), parse_json_obj(F.substr(F.col(line), F.nullif(F.instr(line, "{"), F.lit(0)))).alias("o"))
    field = lambda name: F.col("o")[name]
    rows = rows.select(field("applyCode").alias("apply_code"), "create_time", parse_json_obj(field("inputSystem")).alias("a"), parse_json_obj(field("inputThird")).alias("b"), parse_kv_list(field("resultDecision")).alias("outputs"))
    rows = rows.select("apply_code", "create_time", F.map_entries(json_merge("a", "b")).alias("inputs"), "outputs")
    tagged = lambda kind, entries: F.transform(F.filter(F.coalesce(entries, F.array()), lambda e: e["value"].isNotNull()), lambda e, i: F.struct(F.lit(kind).alias("var_type"), indexed_name(e["key"]).alias("name"), i.alias("at"), e["value"].alias("value")))
    rows = rows.withColumn("entries", F.sort_array(F.concat(tagged("input", "inputs"), tagged("output", "outputs")))).drop("inputs", "outputs")
    # sorted by kind, base and index: entries of one base stand together, and of one index the last counts
    after = lambda e, i, own: F.get(own, i + 1)
    rows = rows.withColumn("last", F.filter("entries", lambda e, i: ~((after(e, i, "entries")["var_type"] == e["var_type"]) & (after(e, i, "entries")["name"] == e["name"])) | (i + 1 == F.size("entries"))))
    same = lambda x, y: (x["var_type"] == y["var_type"]) & (x["name"]["base"] == y["name"]["base"])
    begins = F.filter(F.sequence(F.lit(0), F.size("last") - 1), lambda i: (i == 0) | ~same(F.get("last", i - 1), F.get("last", i)))
    # no filter on it: Spark would push the whole expression down and compute it for each entry
    rows = rows.withColumn("begins", F.when(F.size("last") > 0, begins))
    run = lambda b, k: F.slice("last", b + 1, F.coalesce(F.get("begins", k + 1), F.size("last")) - b)
    joined = lambda b, k: F.array_join(F.transform(run(b, k), lambda e: e["value"]), "|")
    found = F.transform("begins", lambda b, k: F.struct(F.get("last", b)["var_type"].alias("var_type"), F.get("last", b)["name"]["base"].alias("key"), joined(b, k).alias("value")))
    return rows.select("apply_code", "create_time", F.explode(found).alias("v")).select("apply_code", "create_time", "v.*")


def variables(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col("var_type") == kind)
