"""The logical tables of the engine over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_visit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 columns: one row per search, click, order or pay of a session.

    Each 136 events are dealt to 16 sessions of 1, 2, ... 16 actions: ``j`` is the session among these.
    """
    k, j = F.get_json_object("props", "$.k").cast("long"), F.expr("cast(floor((sqrt(8 * (event_id % 136) + 1) - 1) / 2) as bigint)")
    events = table(spark, sf_dir, "events").select("event_type", "event_id", k.alias("k"), j.alias("j"))
    events = events.selectExpr("event_type", "k", "event_id div 136 * 16 + j sn", "event_id % 136 - j * (j + 1) div 2 i")
    kind = lambda name, value: F.when(F.col("event_type") == name, value)
    return events.selectExpr("*", "date_add(date'2024-01-01', cast(sn % 30 as int)) day").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        (F.col("sn") % 150).alias("user_id"),
        F.concat(F.lit("s"), "sn").alias("session_id"),
        (F.col("k") % 10).alias("page_id"),
        F.expr("date_format(cast(day as timestamp) + make_dt_interval(0, cast(sn * 7 % 24 as int), 0, i * ((sn % 40) * (sn % 40)) div 10), 'yyyy-MM-dd HH:mm:ss')").alias("action_time"),
        kind("view", F.concat(F.lit("kw"), F.col("k") % 10)).alias("search_keyword"),
        kind("click", F.col("k")).alias("click_category_id"),
        kind("click", F.col("k") * 7 % 100).alias("click_product_id"),
        kind("signup", F.concat_ws(",", "k", (F.col("k") + 7) % 100)).alias("order_category_ids"),
        kind("signup", (F.col("k") * 3 % 100).cast("string")).alias("order_product_ids"),
        kind("purchase", F.concat_ws(",", "k", (F.col("k") + 13) % 100)).alias("pay_category_ids"),
        kind("purchase", (F.col("k") * 5 % 100).cast("string")).alias("pay_product_ids"),
        (F.col("k") % 10).alias("city_id"),
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_name").alias("name"), (F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"), F.col("n_name").alias("city"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat(F.lit('{"product_status": '), F.col("p_size") % 2, F.lit("}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), status.alias("extend_info"))


def order_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are strings, as in the source database."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("final_total_amount"), F.col("o_orderstatus").alias("order_status"),
        day("o_orderdate").alias("create_time"), day(F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 5 as int))")).alias("operate_time"),
    )


def order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.col("l_quantity").alias("sku_num"), F.col("l_extendedprice").alias("order_price"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"))


def app_log(events: DataFrame) -> DataFrame:
    """(line, event_id, ts): realtime app logs, start logs for signups, two displays for views; every 50th is cut in half."""
    common = F.concat(F.lit('{"common":{"mid":"m'), "user_id", F.lit('","is_new":"1"},'))
    page = F.concat(F.lit('"page":{"page_id":"p'), F.col("event_id") % 7, F.lit('"}'))
    display = lambda n: F.concat(F.lit('{"item":"i'), F.col("event_id") + n, F.lit('","order":"'), F.lit(n), F.lit('"}'))
    body = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit('"start":{"entry":"e'), F.col("event_id") % 3, F.lit('"}}')))
        .when(F.col("event_type") == "view", F.concat(page, F.lit(',"displays":['), display(1), F.lit(","), display(2), F.lit("]}")))
        .otherwise(F.concat(page, F.lit("}")))
    )
    line = F.concat(common, body)
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    return events.select(cut.alias("line"), "event_id", "ts")


def raw_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_records(table(spark, sf_dir, "orders"))


def change_records(orders: DataFrame) -> DataFrame:
    """Change records of the orders table as a connector delivers them: topic, op, before, after."""
    fields = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("user_id"), F.col("o_custkey").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    none = F.create_map().cast("map<string,string>")
    op = F.element_at(F.array(*map(F.lit, ("CREATE", "UPDATE", "DELETE", "READ"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select(
        F.concat(F.lit("mysql_binlog_source.shop."), F.when(F.col("o_orderkey") % 3 == 0, "order_info").when(F.col("o_orderkey") % 3 == 1, "base_trademark").otherwise("sku_info")).alias("topic"),
        op.alias("op"),
        F.when(op.isin("UPDATE", "DELETE"), fields).otherwise(none).alias("before"),
        F.when(op == "DELETE", none).otherwise(fields).alias("after"),
    )


#: source_table, operate_type, sink_type, sink_table, sink_columns, sink_pk, sink_extend
TABLE_PROCESS = [
    ("order_info", "insert", "kafka", "dwd_order_info", "id,user_id,status", "id", None),
    ("order_info", "update", "kafka", "dwd_order_info_update", "id,status", "id", None),
    ("base_trademark", "insert", "hbase", "dim_base_trademark", "id,priority", None, None),
    ("sku_info", "read", "clickhouse", "ck_sku_info", "id,priority", "id", None),
    ("never_seen", "insert", "kafka", "dwd_never", "id", "id", None),
]


def table_process(spark: SparkSession) -> DataFrame:
    """The routing configuration: a fixed list of five rows."""
    return spark.createDataFrame(TABLE_PROCESS, "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string")
