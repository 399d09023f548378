from pyspark.sql import functions as F

from shopstream.operators import cdc, logs, portrait, sessions, skew, variables, warehouse
from shopstream.sources import io
from shopstream.streaming import pipelines, streams, visitors


def actions(spark, *rows):
    return spark.createDataFrame([(s, 1, t, k, c) for s, t, k, c in rows], "session_id string, user_id long, action_time string, search_keyword string, click_category_id long")


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"


def test_sessions_keep_distinct_values_exactly(spark):
    own = actions(spark, ("a", at(0), "k12", 12), ("a", at(31), "k1", 1), ("a", at(7), "", None), ("b", None, None, None))
    rows = {r.session_id: r for r in sessions.aggregate_sessions(own).collect()}
    assert (rows["a"].keywords, rows["a"].categories, rows["a"].visit_length, rows["a"].step_length) == (["k1", "k12"], [1, 12], 31, 3)
    assert rows["b"].start_time is None and rows["b"].visit_length is None


def test_bucket_edges(spark):
    lengths = [0, 1, 3, 4, 9, 10, 30, 31, 60, 61, 180, 600, 1800, 1801]
    own = spark.createDataFrame([(x, min(x, 70)) for x in lengths], "visit_length long, step_length long")
    r = sessions.session_stats(own).first().asDict()
    assert [r[f"visit_{n}"] for n, _, _ in sessions.VISIT_BUCKETS] == [2, 1, 1, 2, 2, 2, 1, 1, 1]
    assert r["session_count"] == len(lengths) and r["step_60"] == 5
    none = sessions.session_ratios(sessions.session_stats(own.limit(0))).first()
    assert none.session_count == 0 and none["visit_1s_3s_ratio"] is None


def test_extract_is_within_quota(spark):
    rows = [(f"s{i}", f"2024-01-0{1 + i % 2} {i % 3:02}:00:00") for i in range(60)]
    own = spark.createDataFrame(rows, "session_id string, start_time string")
    a, b = (sorted(r.session_id for r in sessions.extract_sessions(own, 20).collect()) for _ in range(2))
    assert a == b and len(a) == 18  # 10 a day, 3 of each of three hours
    assert sessions.extract_sessions(own.limit(0), 20).count() == 0


def test_skewed_joins_equal_the_plain_join(spark):
    left = spark.createDataFrame([(i % 4 if i % 5 else 0, i) for i in range(400)], "k int, x int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(4)], "k int, y string")
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    for df in (skew.salted_join(left, right, "k"), skew.skew_split_join(left, right, "k"), skew.bounded_join(left, right, "k"), skew.bounded_join(left, right, "k", bound=0)):
        assert sorted(map(tuple, df.select("k", "x", "y").collect())) == want
    assert dict(skew.salted_count(left, ["k"]).collect()) == dict(left.groupBy("k").count().collect())


def test_decision_line(spark):
    line = '2019-05-05 10:00:00 INFO {"applyCode":"A1","inputSystem":"{\\"age\\":\\"30\\",\\"phone[2]\\":\\"b\\",\\"phone[1]\\":\\"a\\",\\"x\\":\\"1\\",\\"x[1]\\":\\"2\\",\\"n\\":null}","inputThird":"{\\"score\\":\\"7\\"}","resultDecision":"result=PASS,rule[2]=r2,rule[1]=r1,note="}'
    rows = variables.parse_decisions(spark.createDataFrame([(line,), ("no json",), (None,)], "value string")).collect()
    found = {(r.var_type, r.key): r.value for r in rows}
    assert found == {("input", "age"): "30", ("input", "phone"): "a|b", ("input", "x"): "2", ("input", "score"): "7", ("output", "result"): "PASS", ("output", "rule"): "r1|r2", ("output", "note"): ""}
    assert {(r.apply_code, r.create_time) for r in rows} == {("A1", "2019-05-05 10:00:00")}


def test_log_validity(spark):
    lines = {" {x} ": (True, False), "1700000000000|{a}": (False, True), "170000000000|{a}": (False, False), "1700000000000|{a}|b": (False, False), "1700000000000|a": (False, False)}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", logs.is_start_log("line").alias("s"), logs.is_event_log("line").alias("e")).collect():
        assert (r.s, r.e) == lines[r.line], r.line


def test_logs_without_device_are_dirty(spark):
    df = spark.createDataFrame([('{"page":{"page_id":"1"}}',), ("{",), ('{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"1"},"displays":[]}',)], "line string")
    parsed = logs.parse_logs(df)
    assert logs.dirty(parsed).count() == 2
    good = logs.clean(parsed)
    assert (logs.starts(good).count(), logs.pages(good).count(), logs.displays(good).count()) == (0, 1, 0)


def test_a_log_line_is_parsed_once(spark):
    df = spark.createDataFrame([('{"common":{"mid":"m","is_new":"1"}}', 1), ("{", 2)], "line string, ts long").select(F.concat("line", F.lit("")).alias("line"), "ts")
    good = visitors.flat_logs(logs.clean(logs.parse_logs(df)).withColumn("event_id", F.lit(1))).where("ts < 9 and mid is not null")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r.mid, r.is_new, r.ts) for r in good.collect()] == [("m", "1", 1)]


def test_cdc_rules(spark):
    raw = spark.createDataFrame([("s.db.t", "CREATE", None, {"id": "1"}), ("s.db.t", "READ", None, {"id": "2"}), ("s.db.t", "DELETE", {"id": "1"}, None), ("s.db.t", None, None, None)], "topic string, op string, before map<string,string>, after map<string,string>")
    own = cdc.normalize_cdc(raw)
    assert sorted(str(r.type) for r in own.collect()) == ["None", "delete", "insert", "read"]
    assert cdc.drop_deletes(own).count() == 3
    changes = spark.createDataFrame([("t", "insert", 1, "update"), ("t", "insert", 2, "delete"), ("u", "insert", 1, "update")], "source_table string, operate_type string, v int, type string")
    assert [r.source_table for r in cdc.latest_config(changes, "v").collect()] == ["u"]


def test_dim_upsert_survives_a_repeated_batch(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    two = spark.createDataFrame([("a", 3, "w")], "k string, t int, v string")
    for batch, k in ((one, 0), (two, 1), (two, 1)):
        pipelines.upsert_dim(batch, path, ["k"], ["t"], f"{k},run")
    assert sorted(map(tuple, pipelines.read_dim(spark, path).collect())) == [("a", 3, "w"), ("b", 1, "z")]
    assert pipelines.read_dim(spark, f"{path}-none") is None


def test_dim_history_survives_a_dropped_checkpoint(spark, tmp_path):
    path, kind = f"file://{tmp_path}/dim", "k string, t int, v string"
    for run, rows in enumerate(([("a", 1, "x"), ("b", 1, "z")], [("a", 2, "y")])):
        spark.createDataFrame(rows, kind).write.parquet(f"file://{tmp_path}/in{run}")
        pipelines.upsert_stream(spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in{run}"), path, ["k"], ["t"])
        (tmp_path / "dim-checkpoint").rename(tmp_path / f"dropped{run}")  # batch numbers begin at 0 again
    assert sorted(map(tuple, pipelines.read_dim(spark, path).collect())) == [("a", 2, "y"), ("b", 1, "z")]


def test_skew_split_of_an_unstable_side(spark):
    """The left side comes in another order each time; no row is lost or doubled."""
    left = spark.range(3000).select(F.when(F.rand(1) < 0.4, 0).when(F.rand(2) < 0.5, 1).otherwise(F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("x")).repartition(7, "x")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(50)], "k int, y string")
    for _ in range(3):
        found = skew.skew_split_join(left.repartition(5), right, "k")
        assert found.count() == 3000 == found.select("x").distinct().count()
    assert skew.hot_keys(left.limit(0), "k") == [] and set(skew.hot_keys(left, "k")) >= {0, 1}
    assert len(skew.hot_keys(left, "k")) <= 10


def test_route_stream_loses_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    rules = [("d", "insert", "hbase", "dim_d", "id,v", "id"), ("d", "update", "hbase", "dim_d", "id,v", "id"), ("c", "insert", "clickhouse", "ck_c", "id", None), ("k", "insert", "kafka", "k", "id", None)]
    config = spark.createDataFrame(rules, "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string")
    changes = [("s.db.d", "INSERT", {"id": "1", "v": "z"}, 1), ("s.db.d", "UPDATE", {"id": "1", "v": "a"}, 2), ("s.db.c", "INSERT", {"id": "2"}, 3), ("s.db.c", "INSERT", {"id": "3"}, 4), ("s.db.k", "INSERT", {"id": "4"}, 5), ("s.db.x", "INSERT", {"id": "5"}, 6)]
    raw = spark.createDataFrame(changes, "topic string, op string, after map<string,string>, position long").withColumn("before", F.lit(None).cast("map<string,string>"))
    cdc.to_envelope(cdc.normalize_cdc(raw)).coalesce(1).write.text(f"{root}/lines")
    pipelines.route_stream(streams.read_stream(spark, {"path": f"{root}/lines"}), lambda: config, root)
    found = spark.read.parquet(f"{root}/unrouted").orderBy("value").collect()
    assert [(r.sink_type, r.sink_table, r.value) for r in found] == [("clickhouse", "ck_c", '{"id":"2"}'), ("clickhouse", "ck_c", '{"id":"3"}')]
    dim = pipelines.read_dim(spark, f"{root}/dim/dim_d").select("key", F.get_json_object("value", "$.v").alias("v"))
    assert [(r.key, r.v) for r in dim.collect()] == [("1", "a")]
    assert (spark.read.parquet(f"{root}/kafka").count(), spark.read.parquet(f"{root}/unmatched").count()) == (1, 1)
    assert 1 + 1 + 2 + 2 == len(changes)  # kafka, unmatched, unrouted, two changes of the dimension's key


def test_first_seen_spreads_a_device(spark, tmp_path):
    rows = [("a", "1", 2, 1), ("a", "1", 2, 1), ("a", "0", 0, 2), ("a", "1", 3, 3), ("b", "0", 1, 4)], [("a", "1", 1, 5), ("b", "1", 9, 6), ("b", "1", 8, 7), ("c", None, 1, 8)]
    kind = "mid string, is_new string, ts long, event_id long"
    parsed = spark.createDataFrame(rows[0] + rows[1], kind).withColumn("log", F.struct(F.struct("mid", "is_new").alias("common")))
    fixed = logs.fix_is_new(parsed, ["ts", "event_id"])
    assert sorted((r.event_id, r.log.common.is_new) for r in fixed.collect() if r.log.common.is_new == "1") == [(5, "1"), (7, "1")]
    hot = spark.range(400).selectExpr("id", "named_struct('common', named_struct('mid', 'm', 'is_new', '1')) log")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = logs.fix_is_new(hot, ["id"]).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 200
    for own in rows:
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        visitors.fix_is_new_stream(spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in"), ["ts", "event_id"], f"file://{tmp_path}/out")
    found = spark.read.parquet(f"file://{tmp_path}/out/rows")
    assert found.count() == 9 and sorted(r.event_id for r in found.where("is_new = '1'").collect()) == [1, 7]
    assert sorted(r.mid for r in pipelines.read_dim(spark, f"file://{tmp_path}/out/seen").collect()) == ["a", "b"]


def test_warehouse_roundtrip(spark, tmp_path):
    root, house = f"file://{tmp_path}/land", f"file://{tmp_path}/ods"
    source = lambda name: spark.createDataFrame([("1", None, "2024-01-01 10:00:00"), ("2", "a\\b", "2024-01-02 00:00:00")], "id string, name string, create_time string")
    assert warehouse.import_source(source, root, "order_detail", "2024-01-01") == ["order_detail"]
    assert [r.id for r in warehouse.read_landed(spark, root, "order_detail", "2024-01-01").collect()] == ["1"]
    assert len(warehouse.import_source(source, root, "first", "2024-01-01")) == 23
    assert len(warehouse.load_ods(spark, root, house, "first", "2024-01-01")) == 23
    warehouse.load_ods(spark, root, house, "first", "2024-01-01")
    rows = spark.read.parquet(f"{house}/ods_base_category1").orderBy("id").collect()
    assert [(r.id, r.name, str(r.dt)) for r in rows] == [("1", None, "2024-01-01"), ("2", "a\\b", "2024-01-01")]
    assert "dt" not in spark.read.parquet(f"{house}/ods_base_region").columns
    assert len(warehouse.ODS_SPECS) == 23


def test_results_and_jdbc(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    for k in (1, 2, 1):
        io.write_result(spark.range(k), path, k)
    assert spark.read.parquet(path).count() == 3
    tasks = spark.createDataFrame([(1, '{"startAge":["20"]}')], "task_id long, task_param string")
    assert io.load_task(tasks, 1) == {"startAge": ["20"]} and io.load_task(tasks, 2) == {}
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    io.write_jdbc(spark.range(10), options, "t")
    assert io.read_jdbc(spark, options, "select \"id\" from t where \"id\" < 3").count() == 3
    assert io.read_jdbc(spark, options, table="t", split=('"id"', 0, 10, 3)).count() == 10


def test_tags(spark):
    orders = spark.createDataFrame([(1, f"2024-01-0{k} 00:00:00") for k in (1, 2, 3)] + [(2, "2024-01-01 00:00:00")], "user_id int, create_time string")
    found = portrait.active_consumers(orders, "2024-01-05").collect()
    assert [(r.user_id, r.value) for r in found] == [(1, "3")]
    assert found[0].tag_id == "CONSUME_U_01_001"


def test_plans(spark):
    """The date range reaches the scan; nothing runs Python or a product of tables."""
    from shopstream.plans.queries import QUERIES, session_filter

    plan = session_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan
    orders = QUERIES["ods_increment_orders"](spark, "/root/testdata/sf0.001")
    assert "o_orderpriority" not in orders._jdf.queryExecution().executedPlan().toString()
    lines = QUERIES["decision_variables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in lines


def test_session_job_joins_the_actions_once(spark, tmp_path, monkeypatch):
    from shopstream.plans import session_analysis

    rows = [(f"s{i % 5}", i % 5, at(i), "2024-01-01", None, i % 3, None, None) for i in range(60)]
    own = spark.createDataFrame(rows, "session_id string, user_id long, action_time string, date string, search_keyword string, click_category_id long, order_category_ids string, pay_category_ids string")
    users = spark.createDataFrame([(i, 20 + i, "p", "c", "male") for i in range(5)], "user_id long, age int, professional string, city string, sex string")
    joined, details = [], sessions.session_details
    monkeypatch.setattr(sessions, "session_details", lambda kept, actions: joined.append(len(actions.inputFiles())) or details(kept, actions))
    own.write.parquet(f"file://{tmp_path}/actions")
    counts = {}
    names = session_analysis.run_session_analysis(spark.read.parquet(f"file://{tmp_path}/actions"), users, {"startAge": ["21"], "endAge": ["23"]}, f"file://{tmp_path}/out", 1, counts=counts)
    assert counts == {"before": 5, "after": 3} and len(joined) == 2 and len(names) == 6
    assert spark.read.parquet(f"file://{tmp_path}/out/session_detail").count() == 36
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_work")]
