from pyspark.sql import functions as F

from shopstream.functions import jsons, text, times


def one(spark, *columns, row=None):
    df = spark.createDataFrame([row or {"_": 1}])
    return tuple(df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_optional_predicates(spark):
    n, null = F.lit(5), F.lit(None).cast("int")
    assert one(spark, text.opt_between(n, 1, 5), text.opt_between(n, 6, 9), text.opt_between(n, None, 3), text.opt_between(null, 1, 9), text.opt_between(null, 1, None)) == (True, False, True, False, True)
    arr, none = F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>")
    assert one(spark, text.opt_overlaps(arr, ["b", "x"]), text.opt_overlaps(arr, ["x"]), text.opt_overlaps(arr, None), text.opt_overlaps(none, ["a"])) == (True, False, True, False)
    assert one(spark, text.opt_equal(n, 5), text.opt_equal(n, None), text.opt_equal(null, 5)) == (True, True, False)


def test_params():
    assert text.param({"a": ["x", "y"]}, "a") == "x" and text.param({}, "a") is None and text.param({"a": []}, "a") is None
    assert text.param_list({"a": ["1,2", "3"]}, "a") == ["1", "2", "3"]


def test_pipe_records(spark):
    r = F.lit("a=1|b=|c=x=y|a=2")
    assert one(spark, *[text.pipe_get(r, k) for k in "abcd"]) == ("1", None, None, None)
    assert one(spark, text.pipe_set(r, "a", F.lit("9")), text.pipe_set(r, "z", F.lit("9"))) == ("a=9|b=|c=x=y|a=2", "a=1|b=|c=x=y|a=2")


def test_small_codecs(spark):
    assert one(spark, text.trim_comma(F.lit(",a,,b,")), text.pad2(F.lit("7")), text.pad2(F.lit("17")), text.pad2(F.lit("117"))) == ("a,,b", "07", "17", "0117")
    assert one(spark, text.csv_to_longs(F.lit("1,x,3")), text.is_blank(F.lit(None).cast("string")), text.not_blank(F.lit("a"))) == ([1, 3], True, True)
    assert one(spark, text.indexed_name(F.lit("x[3]")), text.indexed_name(F.lit("x"))) == (("x", 3), ("x", 1))
    assert one(spark, text.parse_kv_list(F.lit("a=1, b[2]=x,c=,d=1=2")))[0] == [("a", "1"), ("b[2]", "x"), ("c", ""), ("d", "")]
    assert one(spark, text.ratio(F.lit(1), F.lit(0)), text.ratio(F.lit(1), F.lit(3), 2)) == (None, 0.33)


def test_times(spark):
    a, b, bad = F.lit("2024-01-01 00:00:05"), F.lit("2024-01-01 00:00:01"), F.lit("x")
    assert one(spark, times.seconds_between(a, b), times.seconds_between(a, bad), times.time_after(a, b), times.time_before(a, b), times.time_before(a, bad)) == (4, 0, True, False, False)
    assert one(spark, times.date_hour(F.lit("2024-01-01 7:00:00")), times.epoch_day(F.lit(0))) == ("2024-01-01_7", "19700101")


def test_json(spark):
    a, b = (F.from_json(F.lit(x), "map<string,string>") for x in ('{"x":"1","y":"2"}', '{"y":"3"}'))
    assert one(spark, jsons.json_merge(a, b), jsons.json_put(a, "z", F.lit("4"))) == ({"x": "1", "y": "3"}, {"x": "1", "y": "2", "z": "4"})
    assert one(spark, *[jsons.parse_json_obj(F.lit(x)) for x in ("{", "", "[1]", '{"a":1}')]) == (None, None, None, {"a": "1"})
    assert one(spark, jsons.project_json(a, F.lit("y,q")))[0] == {"y": "2"}


def test_small_helpers(spark, tmp_path):
    from shopstream.functions import jsons, text, times
    from shopstream.operators import warehouse
    from shopstream.sources import io
    from shopstream.streaming import pipelines, streams

    df = spark.createDataFrame([("2024-02-03", "20240203", '{"a":{"b":1}}', ["x", "y"], {"k": "v"}, 1)], "day string, key string, js string, arr array<string>, m map<string,string>, n int")
    r = df.select(
        times.day_of("day").cast("string").alias("day"), times.parse_date_key("key").cast("string").alias("key"), times.format_date("day").alias("format"),
        (times.today() > times.yesterday()).alias("later"), jsons.json_path("js", "a.b").alias("path"), jsons.to_json_str("m").alias("text"), text.join_with("arr", "-").alias("joined"), jsons.struct_to_map(df, ["day", "n"]).alias("map"),
    ).first()
    assert (r.day, r.key, r.format, r.later, r.path, r.text, r.joined, r["map"]) == ("2024-02-03", "2024-02-03", "2024-02-03", True, "1", '{"k":"v"}', "x-y", {"day": "2024-02-03", "n": "1"})
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    assert [x.value for x in io.read_lines(spark, f"file://{tmp_path}/logs").collect()] == ["one", "two"]
    assert io.scan_partition(df, "key", "20240203").count() == 1 and io.scan_partition(df, "key", "x").count() == 0
    streams.run_batches(streams.stream_logs(spark, f"file://{tmp_path}/logs"), lambda b, k: streams.write_batch(b, f"file://{tmp_path}/out", k), f"file://{tmp_path}/ck")
    assert sorted(x.line for x in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["one", "two"]
    assert streams.stream_options("t", "g", "initial") == {"subscribe": "t", "kafka.group.id": "g", "startingOffsets": "earliest"}
    try:
        spark.sql(f"create database made_here location 'file://{tmp_path}/made'")
        for _ in range(2):
            pipelines.ensure_table(spark, "made_here", "dim_t", "id, name", f"file://{tmp_path}/dim_t")
            warehouse.create_ods(spark, "made_here", f"file://{tmp_path}/ods")
        assert spark.table("made_here.dim_t").columns == ["id", "name"] and spark.table("made_here.ods_order_info").columns[-1] == "dt"
        assert spark.sql("show tables in made_here").count() == 24
    finally:
        spark.sql("drop database if exists made_here cascade")
