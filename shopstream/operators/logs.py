"""App logs: validity, topics, dirty records, start / page / display split, first-seen repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Named, col
from .skew import bounded_join

LOG = "struct<common:struct<mid:string,is_new:string>,start:map<string,string>,page:map<string,string>,displays:array<map<string,string>>,broken:string>"
EVENT = "struct<ap:string,cm:map<string,string>,et:array<struct<ett:string,en:string,kv:map<string,string>>>>"


def is_start_log(line: Named) -> Column:
    line = F.trim(col(line))
    return F.coalesce(line.startswith("{") & line.endswith("}"), F.lit(False))


def is_event_log(line: Named) -> Column:
    """``millis|{...}`` with 13 digits and no further pipe."""
    return F.coalesce(col(line).rlike(r"^\d{13}\|\s*\{[^|]*\}\s*$"), F.lit(False))


def etl_logs(logs: DataFrame, line: str = "line") -> DataFrame:
    return logs.where(is_start_log(line) | is_event_log(line))


def tag_logs(logs: DataFrame, line: str = "line") -> DataFrame:
    """The topic that a valid log belongs to."""
    return logs.withColumn("topic", F.when(F.contains(col(line), F.lit("start")), "topic_start").otherwise("topic_event"))


def parse_logs(logs: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``log``; null for dirty lines: what is no JSON object of this form, or has no device id.

    A line is parsed once: ``explode`` keeps filters on ``log`` above the parser, where a plain column would be
    copied into each of them. What the parser can't read whole it reports in the field ``broken``.
    """
    log = F.from_json(col(line), LOG, {"columnNameOfCorruptRecord": "broken"})
    return logs.select("*", F.explode(F.array(log)).alias("_log")).withColumn("log", F.when(F.col("_log.broken").isNull() & F.col("_log.common.mid").isNotNull(), F.col("_log"))).drop("_log")


def dirty(parsed: DataFrame, line: str = "line") -> DataFrame:
    return parsed.where("log is null").select(line)


def clean(parsed: DataFrame) -> DataFrame:
    return parsed.where("log is not null")


def first_new(rows: DataFrame, mid: Column, is_new: Column, order: list[str]) -> DataFrame:
    """(_mid, _first): the least order of a device's rows that say 1; a device's rows are reduced where they are."""
    return rows.where(is_new == "1").groupBy(mid.alias("_mid")).agg(F.min(F.struct(*order)).alias("_first"))


def repeated_new(rows: DataFrame, first: DataFrame, mid: Column, is_new: Column, order: list[str]) -> DataFrame:
    """Adds ``_repeated``: says 1, but is not its device's row in ``first``.

    Rows are joined and counted by device and order together, so the rows of one device are spread.
    """
    at = F.struct(*order)
    found = bounded_join(rows, first, mid.eqNullSafe(F.col("_mid")) & (at == F.col("_first")) & (is_new == "1"), "left")
    hit = F.col("_first").isNotNull()
    # of rows that tie for the first place one counts
    rank = F.row_number().over(Window.partitionBy(mid, at, hit).orderBy(F.lit(1)))
    return found.withColumn("_repeated", (is_new == "1") & ~(hit & (rank == 1))).drop("_mid", "_first")


def fix_is_new(parsed: DataFrame, order: list[str]) -> DataFrame:
    """Of the logs of a device that say ``is_new`` 1, only the first keeps it; batch form."""
    mid, is_new = F.col("log.common.mid"), F.col("log.common.is_new")
    rows = repeated_new(parsed, first_new(parsed, mid, is_new, order), mid, is_new, order)
    log = F.when(F.col("_repeated"), F.col("log").withField("common.is_new", F.lit("0"))).otherwise(F.col("log"))
    return rows.withColumn("log", log).drop("_repeated")


def _is_start() -> Column:
    return F.coalesce(F.size("log.start") > 0, F.lit(False))


def starts(parsed: DataFrame) -> DataFrame:
    return parsed.where(_is_start())


def pages(parsed: DataFrame) -> DataFrame:
    """Page logs; those with displays are here, too."""
    return parsed.where(~_is_start())


def displays(parsed: DataFrame) -> DataFrame:
    """A row per display of a page log, with the page's id."""
    return pages(parsed).select("*", F.explode("log.displays").alias("display")).withColumn("page_id", F.col("log.page")["page_id"])


def flatten_app_events(logs: DataFrame, line: str = "line") -> DataFrame:
    """``millis|{ap, cm, et}`` to a row per item of et, with the common fields."""
    parts = F.split(col(line), r"\|", 2)
    rows = logs.where(is_event_log(line)).select(F.timestamp_millis(parts[0].cast("long")).alias("server_time"), F.from_json(parts[1], EVENT).alias("e"))
    rows = rows.select("server_time", F.col("e.cm")["mid"].alias("mid"), F.col("e.cm")["uid"].alias("uid"), F.explode("e.et").alias("item"))
    return rows.select("server_time", "mid", "uid", F.timestamp_millis(F.col("item.ett").try_cast("long")).alias("event_time"), F.col("item.en").alias("event"), F.col("item.kv").alias("fields"))
