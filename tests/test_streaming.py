"""Dimension store, routing by versions of rules, one commit a batch, and the state of first-seen repair."""

import json
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shopstream.operators import cdc, logs
from shopstream.plans import queries
from shopstream.streaming import dimensions, lookups, pipelines, snapshots, streams, visitors

KIND = "k long, t int, v string"


def files(path):
    return {p.parent.name: p.name for p in (path / "data").rglob("part-*.parquet")}


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    dimensions.upsert_dim(spark.range(100_000).selectExpr("id k", "0 t", "'old' v"), path, ["k"], ["t"], "0,s", buckets=96)
    before = files(tmp_path / "dim")
    assert len(before) == 96  # a file each
    batch = spark.range(30).selectExpr("id * 7 k", "1 t", "'new' v")
    n = dimensions.upsert_dim(batch, path, ["k"], ["t"], "1,s")
    after = files(tmp_path / "dim")
    changed = {k for k in before if before[k] != after[k]}
    assert len(changed) == n <= 30 and set(after) == set(before)
    rows = dimensions.read_dim(spark, path)
    assert rows.count() == 100_000 and rows.where("v = 'new'").count() == 30 and rows.columns == ["k", "t", "v"]
    assert dimensions.upsert_dim(batch, path, ["k"], ["t"], "1,s") == 0 and files(tmp_path / "dim") == after
    found = dimensions.read_keys(spark, path, batch.select("k"))
    assert found.count() == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket", "_bucket") and str(n) == str(len(changed))
    dimensions.rebucket(spark, path, f"{path}-8", 8)
    assert len(files(tmp_path / "dim-8")) == 8 and dimensions.read_dim(spark, f"{path}-8").where("v = 'new'").count() == 30
    with pytest.raises(ValueError):
        dimensions.upsert_dim(batch, path, ["t"], ["k"], "2,s")


def test_a_driver_that_dies_while_buckets_are_replaced(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/dim"
    rows = lambda *r: spark.createDataFrame(r, KIND)
    dimensions.upsert_dim(rows((1, 1, "a"), (2, 1, "b"), (3, 1, "c")), path, ["k"], ["t"], "0,s", buckets=4)

    def dies(spark, path, settings):  # buckets are gone, new ones not there yet
        for name in dimensions._pending(spark, path):
            for bucket in dimensions._buckets_of(spark, f"{path}/_pending/{name}"):
                dimensions.remove(spark, f"{path}/data/_bucket={bucket}")
            raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(dimensions, "_take_over", dies)
        with pytest.raises(RuntimeError):
            dimensions.upsert_dim(rows((1, 2, "d"), (3, 0, "old")), path, ["k"], ["t"], "1,s")
    want = [(1, 2, "d"), (2, 1, "b"), (3, 1, "c")]
    assert sorted(map(tuple, dimensions.read_dim(spark, path).collect())) == want
    dimensions.upsert_dim(rows((1, 2, "d"), (3, 0, "old")), path, ["k"], ["t"], "1,s")
    assert sorted(map(tuple, dimensions.read_dim(spark, path).collect())) == want and not dimensions._pending(spark, path)


def test_columns_that_come_later(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    dimensions.upsert_dim(spark.createDataFrame([(1, 1, "a"), (None, 1, "n")], KIND), path, ["k"], ["t"], "0,s")
    dimensions.upsert_dim(spark.createDataFrame([(2, 1, "b", 7)], KIND + ", w int"), path, ["k"], ["t"], "1,s")
    dimensions.upsert_dim(spark.createDataFrame([], KIND), path, ["k"], ["t"], "2,s")
    dimensions.upsert_dim(spark.createDataFrame([(None, 2, "m")], KIND), path, ["k"], ["t"], "3,s")
    assert sorted(map(tuple, dimensions.read_dim(spark, path).collect()), key=str) == [(1, 1, "a", None), (2, 1, "b", 7), (None, 2, "m", None)]


RULES = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string"


def lines_of(spark, *changes):
    raw = spark.createDataFrame(changes, "topic string, op string, after map<string,string>, position long").withColumn("before", F.lit(None).cast("map<string,string>"))
    return cdc.to_envelope(cdc.normalize_cdc(raw)).coalesce(1)


def test_outputs_add_up_to_inputs(spark, tmp_path):
    root = f"file://{tmp_path}"
    config = spark.createDataFrame([("d", "insert", "hbase", "dim_d", "v", None), ("k", "insert", "kafka", "k", "id", None), ("c", "insert", "clickhouse", "c", "id", None)], RULES)
    changes = [("s.db.d", "INSERT", {"id": str(i), "v": "x"}, i) for i in range(5)] + [("s.db.d", "INSERT", {"v": "no key"}, 9), ("s.db.k", "INSERT", {"id": "4"}, 5), ("s.db.c", "INSERT", {"id": "4"}, 5), ("s.db.x", "INSERT", {"id": "5"}, 6)]
    broken = spark.createDataFrame([('{"database":"db","tableName":"k","before":{},"after":{"id":',), ("no json",)], "value string")
    lines_of(spark, *changes).unionByName(broken).coalesce(1).write.text(f"{root}/lines")
    pipelines.route_stream(streams.read_stream(spark, {"path": f"{root}/lines"}), lambda: config, root)
    count = lambda name: streams.read_committed(spark, root, name).count()
    dim = pipelines.read_routed_dim(spark, root, "dim_d").collect()
    assert sorted(r.key for r in dim) == list("01234") and all('"id"' in r.value for r in dim)
    assert [count(n) for n in ("kafka", "unrouted", "unmatched", "dirty")] == [1, 2, 1, 2]
    assert len(dim) + 1 + 2 + 1 + 2 == len(changes) + 2


def test_two_rules_of_a_key_are_an_error(spark):
    row = cdc.from_envelope(lines_of(spark, ("s.db.k", "INSERT", {"id": "4"}, 5)))
    rule = ("k", "insert", "kafka", "k", "id", None)
    assert cdc.route_cdc(row, spark.createDataFrame([rule, rule], RULES)).count() == 1
    with pytest.raises(Exception, match="two rules for k, insert"):
        cdc.route_cdc(row, spark.createDataFrame([rule, ("k", "insert", "kafka", "l", "id", None)], RULES)).collect()


def test_changes_of_one_table_stay_spread(spark):
    rows = cdc.from_envelope(lines_of(spark, ("s.db.k", "INSERT", {"id": "4"}, 5)))
    rule = spark.createDataFrame([("k", "insert", "kafka", "k", "id", None)], RULES)
    changes = rule.withColumns({"position": F.lit(1).cast("long"), "type": F.lit("update")})
    for config in (rule, cdc.rule_versions(changes)):
        plan = cdc.route_cdc(rows, config)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rules_hold_from_their_position(spark):
    changes = [("k", "insert", "kafka", "one", "id", None, 10, "update"), ("k", "insert", "kafka", "two", "id", None, 20, "update"), ("k", "insert", "kafka", "two", "id", None, 30, "delete"), ("k", "insert", "kafka", "one", "id", None, 10, "update")]
    versions = cdc.rule_versions(spark.createDataFrame(changes, RULES + ", position long, type string"))
    rows = cdc.from_envelope(lines_of(spark, *[("s.db.k", "INSERT", {"id": str(p)}, p) for p in (9, 10, 19, 20, 29, 30, 99)], ("s.db.k", "INSERT", {"id": "-1"}, None)))
    found = {r.after["id"]: r.sink_table for r in cdc.route_cdc(rows, versions).collect()}
    assert found == {"9": None, "10": "one", "19": "one", "20": "two", "29": "two", "30": None, "99": None, "-1": None}


def test_a_job_stopped_between_sinks_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    config = spark.createDataFrame([("d", "insert", "hbase", "dim_d", "v", None), ("k", "insert", "kafka", "k", "id", None)], RULES)
    lines_of(spark, ("s.db.d", "INSERT", {"id": "1", "v": "x"}, 1), ("s.db.k", "INSERT", {"id": "4"}, 5)).write.text(f"{root}/lines")
    run = lambda: pipelines.route_stream(streams.read_stream(spark, {"path": f"{root}/lines"}), lambda: config, root)

    def shown():
        kafka = streams.read_committed(spark, root, "kafka")
        return (0 if kafka is None else kafka.count()), pipelines.read_routed_dim(spark, root, "dim_d").count()

    for name, want in (("commit_batch", (0, 0)), ("_fold", (1, 1))):
        with monkeypatch.context() as m:
            m.setattr(pipelines, name, lambda *a: 1 / 0)
            with pytest.raises(Exception):
                run()
        assert shown() == want
    run()
    assert shown() == (1, 1) and dimensions.read_dim(spark, f"{root}/dim/dim_d").count() == 1 and not (tmp_path / "changes/batch=0").exists()


def test_first_seen_state(spark, tmp_path):
    kind, root = "mid string, is_new string, ts long", f"file://{tmp_path}"
    given = [[("a", "1", 2), ("a", "1", 1), ("b", "0", 1)], [("a", "1", 3), ("b", "1", 4)], [("c", "1", 5), ("b", "1", 6)]]
    known = []
    for k, rows in enumerate(given):  # each a restart of the stream
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/in/part={k}")
        known += visitors.fix_is_new_stream(spark.readStream.schema(kind).parquet(f"{root}/in"), ["ts"], f"{root}/out")
    assert [p["numRowsTotal"] for p in known] == [1, 2, 3]
    rows = spark.read.parquet(f"{root}/out/rows")
    assert rows.count() == 7 and sorted((r.mid, r.ts) for r in rows.where("is_new = '1'").collect()) == [("a", 1), ("b", 4), ("c", 5)]


def test_first_seen_state_forgets(spark, tmp_path):
    kind, root = "mid string, is_new string, ts long", f"file://{tmp_path}"
    for k, rows in enumerate(([("a", "1", 1)], [("a", "1", 2), ("b", "1", 2)], [("c", "1", 3)], [("a", "1", 4)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/in/part={k}")
        visitors.fix_is_new_stream(spark.readStream.schema(kind).parquet(f"{root}/in"), ["ts"], f"{root}/out", ttl="1 second")
        time.sleep(1.5)
    new = spark.read.parquet(f"{root}/out/rows").where("is_new = '1'")
    assert ("a", 4) in {(r.mid, r.ts) for r in new.collect()}


def test_first_seen_in_cuts_of_one_pass(spark, tmp_path, monkeypatch):
    count = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda line: count.add(1) or line).asNondeterministic()
    parse = logs.parse_logs
    monkeypatch.setattr(logs, "parse_logs", lambda rows: parse(rows.withColumn("line", counted("line"))))
    day = lambda n: datetime(2024, 1, n)
    given = [(1, day(1), 7), (2, day(2), 7), (3, None, 7), (4, None, 8), (5, day(3), 9), (50, day(4), 9), (6, day(4), 9)]
    for name, rows, new in (("some", given, {1, 4, 5}), ("timeless", [(1, None, 7)], {1}), ("none", [], set())):
        count.value = 0
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").withColumn("event_type", F.lit("view")).write.parquet(f"file://{tmp_path}/{name}/events.parquet")
        found = queries.QUERIES["new_visitor_state_stream"](spark, f"file://{tmp_path}/{name}").collect()
        assert sorted((r.event_id, r.is_new) for r in found) == sorted((i, "1" if i in new else "0") for i, *_ in rows if i != 50)  # 50 is dirty
        assert count.value == len(rows)


def test_late_dimension_rows_repair_what_waits(spark, tmp_path):
    root, kind = f"file://{tmp_path}", "k long, x long"
    dims = [spark.createDataFrame([(1, "one")], "k long, v string"), spark.createDataFrame([(1, "one"), (2, "two")], "k long, v string")]
    batches = [[(1, 0), (2, 1), (None, 2)] + [(9, i) for i in range(3, 203)], [(2, 300)]]
    counts = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/in/part={n}")
        stream = spark.readStream.schema(kind).parquet(f"{root}/in").select("k", "x")
        counts += lookups.lookup_stream(stream, lookups.RefreshedDim(lambda d=dims[n]: d), "k", f"{root}/out", most_waiting=64)
    assert counts[0]["waiting"] <= 64 and sum(counts[0].values()) == 201 and counts[0]["overflow"] > 0
    found = {(r.k, r.x): r.v for r in spark.read.parquet(f"{root}/out/found").collect()}
    assert found[(1, 0)] == "one" and found[(2, 300)] == "two" and found[(None, 2)] is None
    everything = lookups.read_looked_up(spark, f"{root}/out").collect()
    assert len(everything) == 204 == len({(r.k, r.x) for r in everything})
    waited = spark.read.parquet(f"{root}/out/waiting/batch=0").where("k = 2").count()
    assert waited == 0 or found[(2, 1)] == "two"


def test_rows_beyond_the_bound_are_looked_up_later(spark, tmp_path):
    root, kind = f"file://{tmp_path}", "k long, x long"
    dims = [[], [], [5], range(150), range(200)]
    batches = [[(i, i) for i in range(200)], [(999, 0)], [(5, 999)], [(0, 999)], [(1, 999)]]
    counts = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/in/part={n}")
        dim = spark.createDataFrame([(k, f"v{k}") for k in dims[n]], "k long, v string")
        stream = spark.readStream.schema(kind).parquet(f"{root}/in").select("k", "x")
        counts += lookups.lookup_stream(stream, lookups.RefreshedDim(lambda d=dim: d), "k", f"{root}/out", most_waiting=32)
        everything = [(r.k, r.x, r.v) for r in lookups.read_looked_up(spark, f"{root}/out").collect()]
        given = [x for b in batches[: n + 1] for x in b]
        assert sorted(everything, key=str) == sorted([(k, x, f"v{k}" if k in dims[n] else None) for k, x in given], key=str)
    assert [sum(c.values()) for c in counts] == [200, 201, 200, 51, 1] and counts[0]["overflow"] >= 168


def test_refreshed_dimension(spark):
    loads = []
    dim = lookups.RefreshedDim(lambda: loads.append(1) or spark.range(len(loads)), 0.5)
    assert (dim().count(), dim().count(), len(loads)) == (1, 1, 1)
    time.sleep(0.6)
    assert (dim().count(), len(loads)) == (2, 2)


def test_a_dimension_is_read_anew_whoever_holds_it(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    upsert = lambda n: dimensions.upsert_dim(spark.createDataFrame([(k, n, f"v{n}") for k in range(n)], KIND), path, ["k"], ["t"], f"{n},s", buckets=2)
    values = lambda rows: sorted((r.k, r.v) for r in rows.collect())
    of = lambda n: [(k, f"v{n}") for k in range(n)]
    upsert(2)
    first, own = lookups.table_dim(spark, path, ["k", "v"]), dimensions.read_dim(spark, path).persist()
    assert values(first()) == values(own) == of(2)
    upsert(3)
    second = lookups.table_dim(spark, path, ["k", "v"])
    assert values(second()) == values(dimensions.read_dim(spark, path)) == of(3)
    assert values(first()) == of(2)  # held
    second.release()
    assert values(first()) == of(2)
    first.release()
    assert values(first()) == of(3)
    first.release()
    own.unpersist()


@pytest.mark.parametrize("seed", range(3))
def test_splice_equals_the_table_for_any_interleaving(spark, tmp_path, seed):
    pick = random.Random(seed)
    log, rows = [], {k: f"old{k}" for k in range(0, 12, 2)}
    states = [dict(rows)]  # the table at each position; those before the log are 0
    for position in range(1, 25):
        k = pick.randrange(12)
        kind = "delete" if k in rows and pick.random() < 0.4 else "update" if k in rows else "insert"
        rows = {x: v for x, v in rows.items() if x != k} | ({} if kind == "delete" else {k: f"v{position}"})
        log.append((k, None if kind == "delete" else f"v{position}", kind, position))
        states.append(dict(rows))
    at = sorted(pick.randrange(25) for _ in range(9))  # low, read and high of three chunks
    ends = iter([at[i] for i in (0, 2, 3, 5, 6, 8)] + [24] * 9)
    cuts = sorted(pick.sample(range(1, 24), 2))

    def read(k):
        own = [(x, v) for x, v in states[at[3 * k + 1]].items() if x // 4 == k] if k < 3 else None
        return None if own is None else spark.createDataFrame(own, "k long, v string")

    kind = "k long, v string, type string, position long"
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 24])):
        spark.createDataFrame(log[a:b], kind).coalesce(1).write.parquet(f"file://{tmp_path}/log/part={n}")
        stream = spark.readStream.schema(kind).parquet(f"file://{tmp_path}/log").select("k", "v", "type", "position")
        applied = snapshots.splice_stream(stream, read, lambda: next(ends), f"file://{tmp_path}/copy", ["k"], buckets=2)
    assert applied == 3
    assert {r.k: r.v for r in snapshots.read_spliced(spark, f"file://{tmp_path}/copy").collect()} == rows


def test_types_survive_an_envelope(spark):
    line = '{"database":"d","tableName":"k","before":{"id":1},"after":{"id":7,"x":1.5,"deep":{"a":[1,"b",null]},"flag":true,"none":null},"type":"insert","position":3}'
    rows = cdc.from_envelope(spark.createDataFrame([(line,)], "value string"), typed=True)
    rule = spark.createDataFrame([("k", "insert", "hbase", "dim", "x,deep,flag,none", None)], RULES)
    found = cdc.route_cdc(rows, rule).select("key", F.to_json("payload").alias("value")).first()
    assert found.key == "7" and json.loads(found.value) == {"id": 7, "x": 1.5, "deep": {"a": [1, "b", None]}, "flag": True, "none": None}
    again = cdc.from_envelope(cdc.to_envelope(rows), typed=True).select(F.to_json("after").alias("after")).first()
    assert json.loads(again.after) == json.loads(line)["after"]
