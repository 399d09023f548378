"""JDBC writes that can be repeated, balanced JDBC reads, and the topic writer against a stand-in sink."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from shopstream.sources import io
from shopstream.streaming import streams


@pytest.fixture
def derby(tmp_path):
    return {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_writing_twice_leaves_the_rows_once(spark, derby):
    rows = lambda task, n: spark.range(n).selectExpr(f"cast({task} as bigint) task_id", "id", "'x' v")
    read = lambda: sorted(map(tuple, io.read_jdbc(spark, derby, table="t").collect()))
    io.write_jdbc_once(rows(1, 40).repartition(3, "id"), derby, "t", "job1", ["task_id"])
    io.write_jdbc_once(rows(2, 5), derby, "t", "job2", ["task_id"])
    for _ in range(2):
        io.write_jdbc_once(rows(1, 7).unionAll(rows(1, 1)), derby, "t", "job1", ["task_id"])
    assert read() == sorted([(1, i, "x") for i in [*range(7), 0]] + [(2, i, "x") for i in range(5)])  # equal rows stay two
    before = read()
    with pytest.raises(Exception):  # the merge fails as a whole
        io.run_in_transaction(spark, derby, ["delete from t", "delete from nowhere"])
    assert read() == before
    with pytest.raises(ValueError):
        io.write_jdbc_once(rows(1, 1), derby, "t", "x; drop", ["task_id"])


def test_uneven_keys_are_read_in_even_parts(spark, derby):
    keys = spark.range(1_000).selectExpr("case when id < 900 then id else (id - 899) * 1000 end k").unionAll(spark.sql("select cast(null as bigint)"))
    io.write_jdbc(keys, derby, "u")
    found = io.read_jdbc_balanced(spark, derby, "u", '"k"', 5)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 1_001 and max(sizes) <= 2 * min(sizes)
    even = io.read_jdbc(spark, derby, table="u", split=('"k"', 0, 101_000, 5))
    assert max(r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()) > 900
    io.write_jdbc(keys.where("k < 0"), derby, "w")
    assert io.read_jdbc_balanced(spark, derby, "w", '"k"', 5).count() == 0


class _Lines(DataSourceWriter):
    def __init__(self, options, schema):
        self.options, self.names = options, schema.fieldNames()

    def write(self, rows):
        from pyspark import TaskContext

        with open(f"{self.options['kafka.bootstrap.servers']}/{TaskContext.get().taskAttemptId()}", "w") as out:
            for r in rows:
                headers = [[h["key"], bytes(h["value"]).decode()] for h in r["headers"]] if "headers" in self.names else []
                out.write(json.dumps([r["topic"] if "topic" in self.names else self.options["topic"], r["value"], headers]) + "\n")
        return WriterCommitMessage()


class StandIn(DataSource):
    """Takes the place of the Kafka sink: its options and columns, lines in a folder."""

    @classmethod
    def name(cls):
        return "topic_stand_in"

    def writer(self, schema, overwrite):
        return _Lines(dict(self.options), schema)


def test_topic_writer(spark, tmp_path):
    spark.dataSource.register(StandIn)
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "topic string, value string")
    streams.write_topic(rows, str(tmp_path), batch="3,stream", sink="topic_stand_in")
    streams.write_topic(rows, str(tmp_path), "all", sink="topic_stand_in")
    sent = sorted(json.loads(x) for p in tmp_path.iterdir() for x in p.read_text().splitlines())
    assert sent == [["a", "one", [["batch", "3,stream"]]], ["all", "one", []], ["all", "two", []], ["b", "two", [["batch", "3,stream"]]]]
