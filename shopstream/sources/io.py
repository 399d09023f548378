"""Readers and writers of batch tables (SRC-*, SNK-*)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_jdbc(spark: SparkSession, options: dict[str, str], query: str | None = None, table: str | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query, or a table read by ``split`` (column, least, most, parts) in parallel."""
    reader = spark.read.format("jdbc").options(**options)
    if query is not None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table)
    if split:
        column, lo, hi, n = split
        reader = reader.options(partitionColumn=column, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(n))
    return reader.load()


def write_jdbc(df: DataFrame, options: dict[str, str], table: str, mode: str = "append", batch: int = 1_000) -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", str(batch)).mode(mode).save()


def balanced_ranges(spark: SparkSession, options: dict[str, str], table: str, column: str, parts: int, accuracy: int = 10_000) -> list[str]:
    """Conditions that cut a table into ``parts`` of about as many rows each, by quantiles of a number column.

    Only the column is read for that, and only the quantiles come to the driver. Rows with a null are in the
    first part. A value that many rows share is in one part, so there may be fewer parts.
    """
    keys = spark.read.format("jdbc").options(**options).option("query", f"select {column} as k from {table}").load().toDF("k")
    shares = [i / parts for i in range(1, parts)]
    cuts = keys.agg(F.percentile_approx("k", shares, accuracy)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} > {a} and {column} <= {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} <= {cuts[0]} or {column} is null", *inner, f"{column} > {cuts[-1]}"]


def read_jdbc_balanced(spark: SparkSession, options: dict[str, str], table: str, column: str, parts: int) -> DataFrame:
    """A table in parallel parts of about as many rows each, however its keys are spread."""
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=balanced_ranges(spark, options, table, column, parts), properties=rest)


def write_jdbc_once(df: DataFrame, options: dict[str, str], table: str, job: str, keys: list[str], batch: int = 1_000) -> None:
    """Writes a job's rows so that a job that runs again, or a task that was tried twice, leaves them once.

    Rows go to a staging table of the job first, with the number that tells a row of one task from all others;
    a task tried again writes the same numbers. Then one transaction replaces the rows of the target that have
    the ``keys`` of a staged row, and drops the staging table. Readers see all of a job or nothing of it. With
    ``keys`` that name the job (such as a task's id), a job replaces what it wrote before. ``df`` must give the
    same partitions when it is computed again; write it to a table first if it doesn't.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"\w+", job):
        raise ValueError("a job is named by letters, digits and underscores")
    staging = f"{table}_staging_{job}"
    own = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_try", F.xxhash64(F.uuid()))  # of a row's tries one counts
    write_jdbc(own, options, staging, "overwrite", batch)
    write_jdbc(df.limit(0), options, table, "append", batch)  # makes the table if there is none
    name = lambda c: f'"{c}"'  # noqa: E731 - as Spark names them
    columns, same = ", ".join(map(name, df.columns)), " and ".join(f"s.{name(k)} = {table}.{name(k)}" for k in keys)
    merge = [f"delete from {table} where exists (select 1 from {staging} s where {same})", f"insert into {table} ({columns}) select {columns} from {staging} s where not exists (select 1 from {staging} o where o.{name('_row')} = s.{name('_row')} and o.{name('_try')} < s.{name('_try')})", f"drop table {staging}"]
    run_in_transaction(spark, options, merge)


def run_in_transaction(spark: SparkSession, options: dict[str, str], statements: list[str]) -> None:
    """All statements or none, on one connection of the driver."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    settings = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            settings.setProperty(k, options[k])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], settings)
    try:
        connection.setAutoCommit(False)
        for sql in statements:
            statement = connection.createStatement()
            statement.executeUpdate(sql)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def load_task(tasks: DataFrame, task_id: int) -> dict[str, list[str]]:
    """The parameters of one task: JSON arrays by name; empty for an unknown task."""
    row = tasks.where(F.col("task_id") == task_id).select("task_param").first()
    return json.loads(row[0]) if row and row[0] else {}


def scan_partition(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def write_result(df: DataFrame, path: str, task_id: int) -> None:
    """Replaces a task's rows of a result table; a repeated run leaves the same."""
    df.withColumn("task_id", F.lit(task_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def camelize(df: DataFrame) -> DataFrame:
    """snake_case columns as camelCase."""
    camel = lambda c: "".join(x if k == 0 else x.capitalize() for k, x in enumerate(c.lower().split("_")))
    return df.toDF(*map(camel, df.columns))
