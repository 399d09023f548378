"""Registered queries of the main library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons, text, times
from ..operators import cdc, logs, portrait, rankings, sessions, skew, traffic, variables, warehouse
from ..sources import bindings as b
from ..sources.shared import shared_path
from ..streaming import lookups, pipelines, snapshots, streams, visitors
from ..streaming.dimensions import move, names_in, upsert_dim

PARAMS = {"startAge": ["10"], "endAge": ["45"], "professionals": ["BUILDING,MACHINERY,AUTOMOBILE"], "sex": ["male"], "keywords": ["kw1,kw2,kw3,kw4"], "categoryIds": ["1,2,3,4,5,6,7,8,9,10,11,12,13,14,15"]}
FLOW = [1, 2, 3, 4]
DAY = "1996-01-05"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


UVA = """
dealt as (select *, floor((sqrt(8 * (event_id % 136) + 1) - 1) / 2)::bigint j from events),
b as (select event_type, cast(json_extract(props, '$.k') as bigint) k, event_id // 136 * 16 + j sn, event_id % 136 - j * (j + 1) // 2 i from dealt),
uva as (
  select strftime(date '2024-01-01' + (sn % 30)::int, '%Y-%m-%d') as date, sn % 150 user_id, 's' || sn session_id, k % 10 page_id,
    strftime(date '2024-01-01' + (sn % 30)::int + to_hours((sn * 7 % 24)::int) + to_seconds((i * ((sn % 40) * (sn % 40)) // 10)), '%Y-%m-%d %H:%M:%S') action_time,
    case when event_type = 'view' then 'kw' || (k % 10) end search_keyword,
    case when event_type = 'click' then k end click_category_id,
    case when event_type = 'click' then (k * 7) % 100 end click_product_id,
    case when event_type = 'signup' then k || ',' || ((k + 7) % 100) end order_category_ids,
    case when event_type = 'signup' then '' || (k * 3) % 100 end order_product_ids,
    case when event_type = 'purchase' then k || ',' || ((k + 13) % 100) end pay_category_ids,
    case when event_type = 'purchase' then '' || (k * 5) % 100 end pay_product_ids,
    k % 10 city_id
  from b)"""
USERS = """
users as (
  select c_custkey user_id, (c_custkey % 60)::int age, c_mktsegment professional, n_name city, case when c_custkey % 2 = 0 then 'male' else 'female' end sex
  from customer join nation on c_nationkey = n_nationkey)"""
SESS = f"""{UVA},
sess as (
  select session_id, min(user_id) user_id, list_sort(list(distinct search_keyword) filter (search_keyword <> '')) keywords,
    list_sort(list(distinct click_category_id) filter (click_category_id is not null)) categories, min(action_time) start_time,
    epoch(max(action_time)::timestamp - min(action_time)::timestamp)::bigint visit_length, count(*) step_length
  from uva group by session_id)"""
PROF = f"{SESS}, {USERS}, prof as (select sess.*, age, professional, city, sex from sess join users using (user_id))"
_SESSION = "session_id, user_id, coalesce(array_to_string(keywords, ','), '') keywords, coalesce(array_to_string(categories, ','), '') categories, start_time, visit_length, step_length"
_PROFILE = f"{_SESSION}, age, professional, city, sex"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("keywords", F.array_join("keywords", ",")).withColumn("categories", F.array_join("categories", ","))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.aggregate_sessions(b.user_visit_action(spark, sf))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_profiles(_sessions(spark, sf), b.user_info(spark, sf))


@query(f"with {UVA} select * from uva where date between '2024-01-05' and '2024-01-12'")
def scan_actions_by_date(spark, sf):
    return sessions.scan_actions(b.user_visit_action(spark, sf), "2024-01-05", "2024-01-12")


@query("with " + USERS + " select * from users")
def scan_users(spark, sf):
    return b.user_info(spark, sf).select("user_id", "age", "professional", "city", "sex")


@query("select p_partkey product_id, p_name product_name, (p_size % 2)::int status from part")
def product_status(spark, sf):
    from ..functions.jsons import product_status as status

    return b.product_info(spark, sf).select("product_id", "product_name", status("extend_info").alias("status"))


@query(f"with {SESS} select {_SESSION} from sess")
def session_aggregate(spark, sf):
    return _flat(_sessions(spark, sf))


@query(f"with {PROF} select {_PROFILE} from prof")
def session_profiles(spark, sf):
    return _flat(_profiles(spark, sf))


@query(ORACLES["session_profiles"])
def session_profiles_broadcast(spark, sf):
    return _flat(sessions.session_profiles(_sessions(spark, sf), b.user_info(spark, sf), "broadcast"))


def _users(spark, sf):
    return b.user_info(spark, sf).select("user_id", "age", "professional", "city", "sex")


@query(ORACLES["session_profiles"])
def session_profiles_salted(spark, sf):
    return _flat(skew.salted_join(_sessions(spark, sf), _users(spark, sf), "user_id"))


@query(ORACLES["session_profiles"])
def session_profiles_skew_split(spark, sf):
    return _flat(skew.skew_split_join(_sessions(spark, sf), _users(spark, sf), "user_id"))


FILTERED = f"""{PROF},
kept as (
  select * from prof where age between 10 and 45 and professional in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') and sex = 'male'
    and list_has_any(keywords, ['kw1', 'kw2', 'kw3', 'kw4']) and list_has_any(categories, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]))"""


@query(f"with {FILTERED} select {_PROFILE} from kept")
def session_filter(spark, sf):
    return _flat(sessions.filter_sessions(_profiles(spark, sf), PARAMS))


@query(f"with {FILTERED} select 'before' step, count(*) n from prof union all select 'after', count(*) from kept")
def session_filter_summary(spark, sf):
    own = _profiles(spark, sf)
    return sessions.filter_summary(own, sessions.filter_sessions(own, PARAMS))


def _bucket_sql(form: str) -> str:
    own = [("visit", "visit_length", sessions.VISIT_BUCKETS), ("step", "step_length", sessions.STEP_BUCKETS)]
    return ", ".join(form.format(c=c, test=f"{c} >= {lo}" + (f" and {c} <= {hi}" if hi else ""), name=f"{kind}_{n}") for kind, c, buckets in own for n, lo, hi in buckets)


@query(f"with {PROF} select count(*) session_count, {_bucket_sql('count(*) filter ({test}) {name}')} from prof")
def session_stats(spark, sf):
    return sessions.session_stats(_profiles(spark, sf))


@query(f"with {PROF} select count(*) session_count, {_bucket_sql('count(*) filter ({test}) / nullif(count(*), 0)::double {name}_ratio')} from prof")
def session_ratios(spark, sf):
    return sessions.session_ratios(sessions.session_stats(_profiles(spark, sf)), None)


HOURS = f"""{SESS},
hours as (select replace(left(start_time, 13), ' ', '_') date_hour, count(*) n from sess group by 1),
hour_days as (select *, (sum(n) over (partition by left(date_hour, 10)))::bigint day_n from hours)"""


@query(f"with {HOURS} select * from hour_days")
def sessions_per_hour(spark, sf):
    return sessions.sessions_per_hour(_sessions(spark, sf))


EXTRACT = f"""{HOURS},
quota as (select date_hour, least(floor(n / day_n * floor(300 / (select count(distinct left(date_hour, 10)) from hours))), n) quota from hour_days),
ranked as (
  select *, row_number() over (partition by date_hour order by md5('0_' || session_id), session_id) r
  from (select *, replace(left(start_time, 13), ' ', '_') date_hour from sess)),
extracted as (select r.* exclude (r) from ranked r join quota using (date_hour) where r <= quota)"""


@query(f"with {EXTRACT} select date_hour, {_SESSION} from extracted")
def session_extract(spark, sf):
    return _flat(sessions.extract_sessions(_sessions(spark, sf), 300))


DETAIL = "user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"


@query(f"with {EXTRACT} select 1::bigint task_id, {DETAIL} from uva where session_id in (select session_id from extracted)")
def extract_details(spark, sf):
    own = b.user_visit_action(spark, sf)
    return sessions.to_session_detail(sessions.session_details(sessions.extract_sessions(sessions.aggregate_sessions(own), 300), own), 1)


EVENTS = f"""{UVA},
ce as (
  select session_id, 'click' kind, click_category_id category_id from uva where click_category_id is not null
  union all select session_id, 'order', unnest(string_split(order_category_ids, ','))::bigint from uva
  union all select session_id, 'pay', unnest(string_split(pay_category_ids, ','))::bigint from uva),
cc as (
  select category_id, count(*) filter (kind = 'click') click_count, count(*) filter (kind = 'order') order_count, count(*) filter (kind = 'pay') pay_count
  from ce group by category_id),
top as (select * from cc order by click_count desc, order_count desc, pay_count desc, category_id limit 10),
sc as (select session_id, click_category_id category_id, count(*) click_count from uva where click_category_id is not null group by 1, 2),
ts as (
  select * from (select *, row_number() over (partition by category_id order by click_count desc, session_id) as rank from sc where category_id in (select category_id from top))
  where rank <= 10)"""


@query(f"with {EVENTS} select * from ce")
def category_events(spark, sf):
    return rankings.category_events(b.user_visit_action(spark, sf))


@query(f"with {EVENTS} select * from cc")
def category_counts(spark, sf):
    return rankings.category_counts(category_events(spark, sf))


@query(ORACLES["category_counts"])
def category_counts_salted(spark, sf):
    return rankings.category_counts_salted(category_events(spark, sf))


@query(f"with {EVENTS} select kind, category_id, count(*) n from ce group by 1, 2")
def salted_count(spark, sf):
    return skew.salted_count(category_events(spark, sf), ["kind", "category_id"]).select("kind", "category_id", "n")


@query(f"with {EVENTS} select * from top")
def top_categories(spark, sf):
    return rankings.top_categories(category_counts(spark, sf))


@query(f"with {EVENTS} select * from sc")
def session_category_clicks(spark, sf):
    return rankings.session_category_clicks(b.user_visit_action(spark, sf))


def _top_sessions(spark, sf):
    return rankings.top_sessions(session_category_clicks(spark, sf), top_categories(spark, sf))


@query(f"with {EVENTS} select * from ts")
def top_sessions(spark, sf):
    return _top_sessions(spark, sf)


@query(f"with {EVENTS} select {DETAIL} from uva join (select session_id from ts) using (session_id)")
def top_session_details(spark, sf):
    own = rankings.top_session_details(_top_sessions(spark, sf), b.user_visit_action(spark, sf))
    return own.select(*DETAIL.split(", "))


def _decision_lines(spark, sf):
    o = lambda c: F.col(c).cast("string")
    quoted = lambda x: F.replace(x, F.lit('"'), F.lit('\\"'))
    system = F.concat(F.lit('{"age":"'), o("o_custkey"), F.lit('","phone[2]":"b'), o("o_orderkey"), F.lit('","phone[1]":"a","status":"'), "o_orderstatus", F.lit('"}'))
    third = F.concat(F.lit('{"score":"'), F.col("o_orderkey") % 7, F.lit('","status":"third"}'))
    decision = F.concat(F.lit("result="), "o_orderstatus", F.lit(", rule[2]=r2,rule[1]=r"), F.col("o_orderkey") % 3, F.lit(",note="))
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(' INFO {"applyCode":"A'), o("o_orderkey"), F.lit('","inputSystem":"'), quoted(system), F.lit('","inputThird":"'), quoted(third), F.lit('","resultDecision":"'), decision, F.lit('"}'))
    return b.table(spark, sf, "orders").select(line.alias("value"))


@query("""
with o as (select *, 'A' || o_orderkey apply_code, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') create_time from orders)
select apply_code, create_time, unnest(['input', 'input', 'input', 'input', 'output', 'output', 'output']) var_type,
  unnest(['age', 'phone', 'score', 'status', 'result', 'rule', 'note']) as key,
  unnest(['' || o_custkey, 'a|b' || o_orderkey, '' || (o_orderkey % 7), 'third', o_orderstatus, 'r' || (o_orderkey % 3) || '|r2', '']) as value
from o""")
def decision_variables(spark, sf):
    return variables.parse_decisions(_decision_lines(spark, sf))


@query("""
select 'A' || o_orderkey apply_code, unnest(['result', 'rule', 'note']) as key, unnest([o_orderstatus, 'r' || (o_orderkey % 3) || '|r2', '']) as value from orders""")
def decision_outputs(spark, sf):
    return variables.variables(decision_variables(spark, sf), "output").select("apply_code", "key", "value")


@query("""
select l_orderkey, string_agg(l_partkey::varchar, '|' order by l_linenumber, l_partkey::varchar) parts from lineitem group by 1""")
def merged_by_index(spark, sf):
    own = b.table(spark, sf, "lineitem").withColumn("part", F.col("l_partkey").cast("string"))
    return own.groupBy("l_orderkey").agg(variables.merge_indexed_agg("l_linenumber", "part").alias("parts"))


@query("""
select c_custkey, c_name as name, 'x=1|name=N' || c_custkey || '|y=' as changed, null::varchar as empty, '0' || (c_custkey % 7) as padded, '1,2' as trimmed
from customer""")
def pipe_record_codec(spark, sf):
    own = b.table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("x=1|name="), "c_name", F.lit("|y=")).alias("r"))
    new = F.concat(F.lit("N"), "c_custkey")
    return own.select(
        "c_custkey", text.pipe_get("r", "name").alias("name"), text.pipe_set("r", "name", new).alias("changed"), text.pipe_get("r", "y").alias("empty"),
        text.pad2((F.col("c_custkey") % 7).cast("string")).alias("padded"), text.trim_comma(F.lit(",1,2,")).alias("trimmed"),
    )


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H') date_hour, strftime(o_orderdate, '%Y%m%d') day_key, strftime(o_orderdate, '%Y%m%d%H%M') minute_key,
  (o_orderkey % 5 * 86400)::bigint secs, o_orderkey % 5 > 0 is_before, false is_after
from orders""")
def time_helpers(spark, sf):
    own = b.order_info(spark, sf)
    at = times.parse_time("create_time")
    return own.select(
        F.col("id").alias("o_orderkey"), times.date_hour("create_time").alias("date_hour"), times.date_key(at).alias("day_key"), times.minute_key(at).alias("minute_key"),
        times.seconds_between("operate_time", "create_time").alias("secs"), times.time_before("create_time", "operate_time").alias("is_before"), times.time_after("create_time", "operate_time").alias("is_after"),
    )


_ORDER = "o_orderkey id, o_custkey user_id, o_totalprice final_total_amount, o_orderstatus order_status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') create_time, strftime(o_orderdate + to_days((o_orderkey % 5)::int), '%Y-%m-%d %H:%M:%S') operate_time"


@query(f"select {_ORDER} from orders where o_orderdate::date = date '{DAY}' or (o_orderdate + to_days((o_orderkey % 5)::int))::date = date '{DAY}'")
def ods_increment_orders(spark, sf):
    return warehouse.increment(b.order_info(spark, sf), DAY, warehouse.ODS_SPECS["order_info"].dates)


@query(f"""
with c as (select o_orderkey id, o_orderdate g, o_orderdate + to_days((o_orderkey % 5)::int) u, o_orderdate + to_days((o_orderkey % 11)::int) d from orders)
select id from c where g::date = date '{DAY}' or u::date = date '{DAY}' or d::date = date '{DAY}'""")
def ods_increment_multi_date(spark, sf):
    later = lambda n: F.expr(f"date_format(o_orderdate + make_dt_interval(cast(o_orderkey % {n} as int)), 'yyyy-MM-dd HH:mm:ss')")
    own = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), later(1).alias("get_time"), later(5).alias("using_time"), later(11).alias("used_time"))
    return warehouse.increment(own, DAY, warehouse.ODS_SPECS["coupon_use"].dates).select("id")


@query("select l_orderkey order_id, l_partkey sku_id, l_quantity sku_num, l_extendedprice order_price, o_custkey user_id from lineitem join orders on l_orderkey = o_orderkey")
def ods_order_detail(spark, sf):
    return warehouse.import_order_detail(b.order_detail(spark, sf).drop("create_time"), b.order_info(spark, sf))


@query("""
select o_orderkey::varchar id, o_custkey::varchar user_id, o_orderstatus order_status, case when o_orderkey % 2 = 0 then '2024-01-01' else '2024-01-02' end dt, case when o_orderkey % 2 = 0 then 1.0 else 2.0 end amount
from orders""")
def ods_partition_overwrite(spark, sf):
    """Lands orders of two days, loads both, and loads one again with other values: the other day stays."""
    root = shared_path(spark, "ods")
    own = b.order_info(spark, sf)
    for day, part, amount in (("2024-01-01", 0, 1), ("2024-01-02", 1, 9), ("2024-01-02", 1, 2)):
        rows = own.where(F.col("id") % 2 == part).withColumn("final_total_amount", F.lit(amount))
        warehouse.land(warehouse.conform(rows, warehouse.ODS_SPECS["order_info"]), f"{root}/land", "order_info", day)
        warehouse.overwrite_partition(warehouse.read_landed(spark, f"{root}/land", "order_info", day), f"{root}/ods_order_info", "dt", day)
    found = spark.read.parquet(f"{root}/ods_order_info")
    return found.select("id", "user_id", "order_status", F.col("dt").cast("string").alias("dt"), F.col("final_total_amount").cast("double").alias("amount"))


def _raw_logs(spark, sf):
    """Start logs, event logs, a short time, no JSON, a pipe too many."""
    n = F.col("event_id") % 5
    body = F.concat(F.lit('{"en":"'), F.when(F.col("event_id") % 3 == 0, "start").otherwise("click"), F.lit('","id":'), "event_id", F.lit("}"))
    event = F.concat(F.lit("1700000000000|"), body)
    line = F.when(n == 0, body).when(n == 1, event).when(n == 2, F.concat(F.lit("17|"), body)).when(n == 3, F.lit("no log")).otherwise(F.concat(event, F.lit("|x")))
    return b.table(spark, sf, "events").select("event_id", line.alias("line"))


@query("select event_id from events where event_id % 5 in (0, 1)")
def log_etl(spark, sf):
    return logs.etl_logs(_raw_logs(spark, sf)).select("event_id")


@query("select event_id, case when event_id % 3 = 0 then 'topic_start' else 'topic_event' end topic from events where event_id % 5 in (0, 1)")
def log_multiplex(spark, sf):
    return logs.tag_logs(logs.etl_logs(_raw_logs(spark, sf))).select("event_id", "topic")


def _parsed(spark, sf):
    return logs.parse_logs(b.app_log(b.table(spark, sf, "events")))


@query("select count(*) n from events where event_id % 50 = 0")
def log_dirty(spark, sf):
    return logs.dirty(_parsed(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


START_SQL = "select event_id, 'm' || user_id mid, 'e' || (event_id % 3) entry from events where event_id % 50 <> 0 and event_type = 'signup'"
PAGE_SQL = "select event_id, 'm' || user_id mid, 'p' || (event_id % 7) page_id from events where event_id % 50 <> 0 and event_type <> 'signup'"
DISPLAY_SQL = "select event_id, 'p' || (event_id % 7) page_id, 'i' || (event_id + o) item from events, (values (1), (2)) t(o) where event_id % 50 <> 0 and event_type = 'view'"


def _start(rows):
    return rows.select("event_id", "log.common.mid", F.col("log.start")["entry"].alias("entry"))


def _page(rows):
    return rows.select("event_id", "log.common.mid", F.col("log.page")["page_id"].alias("page_id"))


def _display(rows):
    return rows.select("event_id", "page_id", F.col("display")["item"].alias("item"))


@query(START_SQL)
def log_start(spark, sf):
    return _start(logs.starts(logs.clean(_parsed(spark, sf))))


@query(PAGE_SQL)
def log_page(spark, sf):
    return _page(logs.pages(logs.clean(_parsed(spark, sf))))


@query(DISPLAY_SQL)
def log_display(spark, sf):
    return _display(logs.displays(logs.clean(_parsed(spark, sf))))


@query("""
select event_id, 'm' || user_id mid, case when row_number() over (partition by user_id order by ts, event_id) = 1 then '1' else '0' end is_new from events where event_id % 50 <> 0""")
def new_visitor_batch(spark, sf):
    fixed = logs.fix_is_new(logs.clean(_parsed(spark, sf)), ["ts", "event_id"])
    return fixed.select("event_id", "log.common.mid", "log.common.is_new")


@query(ORACLES["new_visitor_batch"])
def new_visitor_stream(spark, sf):
    root = shared_path(spark, "visitors")
    rows = visitors.flat_logs(logs.clean(logs.parse_logs(b.app_log(streams.events_stream(spark, sf)))))
    visitors.fix_is_new_stream(rows, ["ts", "event_id"], root)
    return spark.read.parquet(f"{root}/rows").select("event_id", "mid", "is_new")


@query(ORACLES["new_visitor_batch"])
def new_visitor_state_stream(spark, sf):
    """The same in three batches, in order of time, and one of rows without a time; what was seen is in the state store."""
    root = shared_path(spark, "visitors-state")
    events = b.table(spark, sf, "events")
    first, second = events.selectExpr("approx_percentile(ts, array(0.33, 0.67))").first()[0] or (None, None)
    rows = visitors.flat_logs(logs.clean(logs.parse_logs(b.app_log(events))))
    part = F.when(F.col("ts") < first, 0).when(F.col("ts") < second, 1).when(F.col("ts").isNotNull(), 2).otherwise(3)
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/cut")  # all cuts in one pass
    parts = [name for name in names_in(spark, f"{root}/cut") if name.startswith("part=")]
    if not parts:  # an empty batch
        parts = ["part=0"]
        rows.limit(0).write.parquet(f"{root}/cut/part=0")
    for name in parts:
        move(spark, f"{root}/cut/{name}", f"{root}/in/{name}")
        visitors.fix_is_new_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/in").select(rows.columns), ["ts", "event_id"], root)
    return spark.read.parquet(f"{root}/rows").select("event_id", "mid", "is_new")


@query(f"""
select 'start' kind, event_id, entry as value from ({START_SQL}) union all select 'page', event_id, page_id from ({PAGE_SQL})
union all select 'display', event_id, item from ({DISPLAY_SQL}) union all select 'dirty', null, 'dirty' from events where event_id % 50 = 0""")
def log_split_stream(spark, sf):
    root = shared_path(spark, "split")
    pipelines.split_logs(b.app_log(streams.events_stream(spark, sf)), root)
    part = lambda name: spark.read.parquet(f"{root}/{name}")
    rows = [("start", _start(part("start")), "entry"), ("page", _page(part("page")), "page_id"), ("display", _display(part("display")), "item")]
    out = part("dirty").select(F.lit("dirty").alias("kind"), F.lit(None).cast("bigint").alias("event_id"), F.lit("dirty").alias("value"))
    for kind, df, value in rows:
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), "event_id", F.col(value).alias("value")))
    return out


@query(ORACLES["log_multiplex"])
def log_multiplex_stream(spark, sf):
    root = shared_path(spark, "topics")
    events = streams.events_stream(spark, sf)
    n = F.col("event_id") % 5
    body = F.concat(F.lit('{"en":"'), F.when(F.col("event_id") % 3 == 0, "start").otherwise("click"), F.lit('","id":'), "event_id", F.lit("}"))
    lines = events.select("event_id", F.when(n == 0, body).when(n == 1, F.concat(F.lit("1700000000000|"), body)).otherwise("no log").alias("line"))
    pipelines.multiplex_logs(lines, root)
    return spark.read.parquet(f"{root}/topics").select("event_id", F.col("topic").cast("string").alias("topic"))


@query("""
select event_id, 'm' || user_id mid, unnest([event_type, 'praise']) as event, epoch_us(ts) // 1000 at_ms from events where event_id % 4 <> 3""")
def app_events_flat(spark, sf):
    item = lambda en: F.concat(F.lit('{"ett":"'), F.unix_millis(F.col("ts").cast("timestamp")), F.lit('","en":"'), en, F.lit('","kv":{"id":"'), "event_id", F.lit('"}}'))
    body = F.concat(F.lit('{"ap":"app","cm":{"mid":"m'), "user_id", F.lit('","uid":"u"},"et":['), item(F.col("event_type")), F.lit(","), item(F.lit("praise")), F.lit("]}"))
    line = F.concat(F.when(F.col("event_id") % 4 == 3, "x").otherwise("1700000000000"), F.lit("|"), body)
    flat = logs.flatten_app_events(b.table(spark, sf, "events").select(line.alias("line")))
    return flat.select(F.col("fields")["id"].cast("bigint").alias("event_id"), "mid", "event", F.unix_millis("event_time").alias("at_ms"))


CDC = """
cdc as (
  select o_orderkey id, o_custkey u, o_orderstatus s, o_orderpriority p, ['insert', 'update', 'delete', 'read'][o_orderkey % 4 + 1] as type,
    ['order_info', 'base_trademark', 'sku_info'][o_orderkey % 3 + 1] as tab
  from orders)"""


def _cdc(spark, sf):
    return cdc.normalize_cdc(b.raw_cdc(spark, sf))


@query(f"""
with {CDC} select 'shop' as database, tab "tableName", type, case when type in ('update', 'delete') then id::varchar end before_id, case when type <> 'delete' then id::varchar end after_id from cdc""")
def cdc_normalized(spark, sf):
    return cdc.from_envelope(cdc.to_envelope(_cdc(spark, sf))).select("database", "tableName", "type", F.col("before")["id"].alias("before_id"), F.col("after")["id"].alias("after_id"))


ROUTED = f"""{CDC},
routed as (
  select case when tab = 'base_trademark' then 'hbase' when tab = 'sku_info' then 'clickhouse' else 'kafka' end sink_type,
    case when tab = 'base_trademark' then 'dim_base_trademark' when tab = 'sku_info' then 'ck_sku_info' when type = 'insert' then 'dwd_order_info' else 'dwd_order_info_update' end sink_table,
    id::varchar id, case when tab = 'order_info' and type = 'insert' then u::varchar end user_id, case when tab = 'order_info' then s end status, case when tab <> 'order_info' then p end priority
  from cdc where (tab, type) in (('order_info', 'insert'), ('order_info', 'update'), ('base_trademark', 'insert'), ('sku_info', 'read')))"""


@query(f"with {ROUTED} select * from routed")
def cdc_routed(spark, sf):
    rows = cdc.route_cdc(cdc.drop_deletes(_cdc(spark, sf)), b.table_process(spark)).where("sink_type is not null")
    return rows.select("sink_type", "sink_table", *[F.col("payload")[c].alias(c) for c in ("id", "user_id", "status", "priority")])


UNMATCHED = f"""{CDC},
unmatched as (
  select tab "tableName", type, count(*) n from cdc
  where type <> 'delete' and (tab, type) not in (('order_info', 'insert'), ('order_info', 'update'), ('base_trademark', 'insert'), ('sku_info', 'read')) group by all)"""


@query(f"with {UNMATCHED} select * from unmatched")
def cdc_unmatched(spark, sf):
    rows = cdc.route_cdc(cdc.drop_deletes(_cdc(spark, sf)), b.table_process(spark))
    return cdc.unmatched(rows).groupBy("tableName", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {ROUTED} select case when sink_type = 'clickhouse' then 'unrouted' else sink_table end sink_table, count(*) n, count(distinct id) ids from routed group by 1
union all select 'unmatched', sum(n)::bigint, null from (with {UNMATCHED} select n from unmatched)""")
def cdc_route_stream(spark, sf):
    """Envelopes written as lines, read as a stream and routed: rows by sink table; those of other sinks are counted, too."""
    root = shared_path(spark, "route")
    cdc.to_envelope(_cdc(spark, sf)).write.text(f"{root}/lines")
    pipelines.route_stream(streams.read_stream(spark, {"path": f"{root}/lines"}), lambda: b.table_process(spark), root)
    kafka = spark.read.parquet(f"{root}/kafka").select(F.col("sink_table").cast("string").alias("sink_table"), F.get_json_object("value", "$.id").alias("id"))
    dim = pipelines.read_dim(spark, f"{root}/dim/dim_base_trademark").select(F.lit("dim_base_trademark").alias("sink_table"), F.col("key").alias("id"))
    lost = spark.read.parquet(f"{root}/unmatched").agg(F.lit("unmatched").alias("sink_table"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("ids"))
    other = spark.read.parquet(f"{root}/unrouted").select(F.lit("unrouted").alias("sink_table"), F.get_json_object("value", "$.id").alias("id"))
    return kafka.unionByName(dim).unionByName(other).groupBy("sink_table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).unionByName(lost)


@query("""
select o_orderkey id, o_totalprice price, o_custkey customer, o_orderpriority priority, o_orderkey % 3 = 0 urgent, 'NUMBER' kind, 'OBJECT<id: BIGINT, tags: ARRAY<STRING>>' nested
from orders""")
def cdc_typed_stream(spark, sf):
    """Numbers, booleans and nested values are captured, sent as envelopes, routed and read back with their types."""
    root = shared_path(spark, "typed")
    orders = streams.table_stream(spark, sf, "orders")
    customer = F.struct(F.col("o_custkey").alias("id"), F.array("o_orderpriority", F.lit("x")).alias("tags"))
    fields = jsons.fields_of(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), customer.alias("customer"), (F.col("o_orderkey") % 3 == 0).alias("urgent")))
    raw = orders.select(F.lit("mysql.shop.order_info").alias("topic"), F.lit("CREATE").alias("op"), fields.alias("after"), F.lit(None).cast("map<string,variant>").alias("before"))
    pipelines.capture_stream(raw, root)
    rules = spark.createDataFrame([("order_info", "insert", "hbase", "dim_order", "price, customer, urgent", "id")], "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string")
    pipelines.route_stream(streams.read_stream(spark, {"path": f"{root}/envelopes/*"}), lambda: rules, root)
    v = F.parse_json("value")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return pipelines.read_routed_dim(spark, root, "dim_order").select(
        get("$.id", "bigint").alias("id"), get("$.price", "double").alias("price"), get("$.customer.id", "bigint").alias("customer"), get("$.customer.tags[0]", "string").alias("priority"), get("$.urgent", "boolean").alias("urgent"),
        F.regexp_replace(F.schema_of_variant(get("$.price", "variant")), r"^(DECIMAL.*|DOUBLE|BIGINT)$", "NUMBER").alias("kind"), F.schema_of_variant(get("$.customer", "variant")).alias("nested"),
    )


#: Rules by the position from which they hold: a sink that changes, one that ends, one that begins late, and a dimension whose columns lack the key.
RULE_CHANGES = [
    ("order_info", "insert", "kafka", "dwd_order_info", "id,user_id,status", None, 0, "update"),
    ("order_info", "insert", "kafka", "dwd_order_info_v2", "id,status", None, 700, "update"),
    ("order_info", "update", "kafka", "dwd_order_info_update", "id", None, 0, "update"),
    ("order_info", "update", "kafka", "dwd_order_info_update", "id", None, 900, "delete"),
    ("base_trademark", "insert", "hbase", "dim_base_trademark", "priority", None, 0, "update"),
    ("sku_info", "read", "clickhouse", "ck_sku_info", "id", None, 300, "update"),
]
RULE_KIND = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, position long, type string"


@query(f"""with {CDC},
found as (
  select id, case
    when tab = 'order_info' and type = 'insert' then case when id < 700 then 'dwd_order_info' else 'dwd_order_info_v2' end
    when tab = 'order_info' and type = 'update' and id < 900 then 'dwd_order_info_update'
    when tab = 'base_trademark' and type = 'insert' then 'dim_base_trademark'
    when tab = 'sku_info' and type = 'read' and id >= 300 then 'unrouted' else 'unmatched' end sink
  from cdc where type <> 'delete'
  union all select null, 'dirty' from orders where o_orderkey % 97 = 0
  union all select null, 'dropped' from cdc where type = 'delete')
select sink, count(*) n, sum(id)::bigint ids from found group by sink""")
def cdc_route_config_stream(spark, sf):
    """Rules come as a stream of changes, records in two batches, with broken lines; each record is routed by the rule of its position."""
    root = shared_path(spark, "route-config")
    spark.createDataFrame(RULE_CHANGES, RULE_KIND).write.parquet(f"{root}/rules")
    pipelines.config_history_stream(spark.readStream.schema(RULE_KIND).parquet(f"{root}/rules"), f"{root}/config")
    raw = b.raw_cdc(spark, sf).withColumn("position", F.coalesce(F.col("after")["id"], F.col("before")["id"]).cast("long"))
    lines = cdc.to_envelope(cdc.normalize_cdc(raw)).withColumn("id", F.get_json_object("value", "$.position").cast("long"))
    cut = lines.where("id % 97 = 0").withColumn("value", F.expr("substring(value, 1, cast(length(value) / 2 as int))"))
    for k, part in enumerate((F.col("id") < 700, F.col("id") >= 700)):
        lines.unionByName(cut).where(part).select("value").write.text(f"{root}/lines/part{k}")
        pipelines.route_stream(streams.read_stream(spark, {"path": f"{root}/lines/*"}), lambda: spark.read.parquet(f"{root}/config/changes").drop("batch"), root)
    own = streams.committed(spark, root)
    sink = lambda name: streams.read_committed(spark, root, name, own)
    count = lambda df, name, value: df.select(name.alias("sink"), F.get_json_object(value, "$.id").cast("long").alias("id"))
    parts = [
        count(sink("kafka"), F.col("sink_table").cast("string"), "value"),
        count(pipelines.read_routed_dim(spark, root, "dim_base_trademark"), F.lit("dim_base_trademark"), "value"),
        count(sink("unrouted"), F.lit("unrouted"), "value"),
        count(sink("unmatched"), F.lit("unmatched"), "after"),
        sink("dirty").select(F.lit("dirty").alias("sink"), F.lit(None).cast("long").alias("id")),
        raw.where("op = 'DELETE'").select(F.lit("dropped").alias("sink"), F.lit(None).cast("long").alias("id")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _config_changes(orders: DataFrame) -> DataFrame:
    return orders.select(F.concat(F.lit("t"), F.col("o_custkey") % 5).alias("source_table"), F.col("o_orderpriority").alias("operate_type"), F.col("o_orderkey").alias("v"), F.when(F.col("o_orderkey") % 7 == 0, "delete").otherwise("update").alias("type"))


@query("""
with c as (select o_custkey % 5 t, o_orderpriority as op, o_orderkey v, case when o_orderkey % 7 = 0 then 'delete' else 'update' end as type from orders),
l as (select t, op, max(v) v, arg_max(type, v) as type from c group by t, op)
select 't' || t source_table, op operate_type, v from l where type <> 'delete'""")
def cdc_latest_config(spark, sf):
    changes = _config_changes(b.table(spark, sf, "orders"))
    return cdc.latest_config(changes, "v").select("source_table", "operate_type", "v")


@query(ORACLES["cdc_latest_config"])
def cdc_config_stream(spark, sf):
    """The configuration as a stream of changes, deletes included, kept in a table."""
    path = shared_path(spark, "config")
    pipelines.config_stream(streams.table_stream(spark, sf, "orders").transform(_config_changes), path, "v")
    return pipelines.read_config(spark, path).select("source_table", "operate_type", "v")


@query(f"""with {CDC} select tab "tableName", type, count(*) n from cdc where tab <> 'base_trademark' group by all""")
def cdc_capture_stream(spark, sf):
    """Two of three tables are captured into envelopes, which are read as a stream again and counted."""
    root, tables = shared_path(spark, "capture"), ["shop.order_info", "shop.sku_info"]
    pipelines.capture_stream(b.change_records(streams.table_stream(spark, sf, "orders")), root, tables)
    own = streams.read_cdc(spark, {"path": f"{root}/envelopes/*"}, tables)
    streams.run_batches(own.select("tableName", "type"), lambda df, k: streams.write_batch(df, f"{root}/rows", k), f"{root}/_read")
    return spark.read.parquet(f"{root}/rows").groupBy("tableName", "type").agg(F.count(F.lit(1)).alias("n"))


@query("""
select user_id, arg_max(event_type, (ts, event_id)) event_type, max((ts, event_id))[2] event_id from events group by user_id""")
def dim_upsert_stream(spark, sf):
    """Events in three files become three batches of upserts of their users' last event."""
    root = shared_path(spark, "dim")
    own = b.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    own.repartition(3, "event_id").write.parquet(f"{root}/in")
    rows = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    pipelines.upsert_stream(rows, f"{root}/users", ["user_id"], ["ts", "event_id"])
    return pipelines.read_dim(spark, f"{root}/users").select("user_id", "event_type", "event_id")


@query("""
select event_id, user_id, c_name, c_mktsegment from events left join customer on c_custkey = user_id""")
def dim_lookup(spark, sf):
    dim = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return cdc.lookup_dim(b.table(spark, sf, "events").select("event_id", "user_id"), dim, "user_id")


@query(ORACLES["dim_lookup"])
def dim_lookup_stream(spark, sf):
    """Events are looked up as they come; two thirds of the customers are there from the start, the rest comes later."""
    root = shared_path(spark, "lookup")
    dim = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    events = b.table(spark, sf, "events").select("event_id", "user_id")
    columns = ["user_id", "c_name", "c_mktsegment"]
    for k, part in enumerate((F.col("user_id") % 3 != 0, F.col("user_id") % 3 == 0)):
        upsert_dim(dim.where(part).withColumn("at", F.lit(k)), f"{root}/dim", ["user_id"], ["at"], f"{k},query")
        events.where(F.col("event_id") % 2 == k).write.parquet(f"{root}/in/part={k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        held = lookups.table_dim(spark, f"{root}/dim", columns, 0)
        lookups.lookup_stream(stream.select("event_id", "user_id"), held, "user_id", f"{root}/out")
        held.release()
    return lookups.read_looked_up(spark, f"{root}/out").select("event_id", *columns)


#: Positions of the change log of ``cdc_snapshot_splice`` come in waves this far apart.
WAVE = 10_000_000_000


def _order_versions(orders: DataFrame) -> DataFrame:
    """All versions of the orders: made, then updated, deleted and made again, each wave for some of them."""
    key = F.col("o_orderkey")
    waves = [("new", "insert", 1), ("up", "update", 2), (None, "delete", 5), ("again", "insert", 10)]
    parts = [orders.where(key % n == 0).select(key.alias("id"), F.lit(status).cast("string").alias("status"), F.lit(kind).alias("type"), (key + k * WAVE).alias("position")) for k, (status, kind, n) in enumerate(waves)]
    return reduce(DataFrame.unionByName, parts)


@query("""
select o_orderkey id, case when o_orderkey % 10 = 0 then 'again' when o_orderkey % 2 = 0 then 'up' else 'new' end status
from orders where o_orderkey % 5 <> 0 or o_orderkey % 10 = 0""")
def cdc_snapshot_splice(spark, sf):
    """A snapshot in four key ranges, each read at another point of the change log, and the changes in three batches."""
    root = shared_path(spark, "splice")
    orders = b.table(spark, sf, "orders")
    versions = _order_versions(orders)
    least, most, half = orders.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.expr("cast(avg(o_orderkey) as bigint)")).first()
    #: The log's end before and after each range is read, and when it is read.
    reads = [(WAVE - 1, WAVE - 1, WAVE - 1), (WAVE - 1, WAVE + half, 2 * WAVE - 1), (WAVE + half, 2 * WAVE + half, 2 * WAVE + most), (3 * WAVE, 3 * WAVE + half, 3 * WAVE + half)]
    ends = iter([p for low, _, high in reads for p in (low, high)] + [4 * WAVE] * 4)

    def read(k: int) -> DataFrame | None:
        if k == len(reads):
            return None
        size = (most - least) // 4 + 1
        range_ = versions.where((F.col("id") >= least + k * size) & (F.col("id") < least + (k + 1) * size))
        return cdc.latest_per_key(range_.where(F.col("position") <= reads[k][1]), ["id"], ["position"]).where("type != 'delete'").select("id", "status")

    for k in (1, 2, 3):
        versions.where(F.col("position").between(k * WAVE, (k + 1) * WAVE - 1)).write.parquet(f"{root}/log/part={k}")
        log = spark.readStream.schema(versions.schema).parquet(f"{root}/log").select(*versions.columns)
        snapshots.splice_stream(log, read, lambda: next(ends), f"{root}/copy", ["id"])
    return snapshots.read_spliced(spark, f"{root}/copy")


@query("""
select user_id::varchar userid, 'c' || user_id cookieid, strftime(ts, '%Y%m%d') signdate, '2024' data_date from events where event_type in ('click', 'view')""")
def cookie_user_signin(spark, sf):
    own = b.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("userid"), F.concat(F.lit("c"), "user_id").alias("cookieid"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_type", F.lit("2024").alias("data_date"))
    part = lambda kind, name: own.where(F.col("event_type") == kind).withColumnRenamed("at", name)
    return portrait.cookie_user_signin(part("click", "eventtime"), part("view", "viewtime"), "2024")


@query(f"""with {UVA},
j as (select page_id p, lead(page_id) over (partition by session_id order by action_time, page_id) q from uva),
n as (select count(*) filter (p = 1) n0, count(*) filter (p = 1 and q = 2) n1, count(*) filter (p = 2 and q = 3) n2, count(*) filter (p = 3 and q = 4) n3 from j)
select unnest([1, 2, 3])::int step, unnest(['1_2', '2_3', '3_4']) jump, unnest([n1, n2, n3]) n, unnest([n1 / nullif(n0, 0)::double, n2 / nullif(n1, 0)::double, n3 / nullif(n2, 0)::double]) rate from n""")
def page_conversion(spark, sf):
    return traffic.page_conversion(b.user_visit_action(spark, sf), FLOW)


@query(f"""with {UVA}, c as (select city_id, click_product_id product_id, count(*) clicks from uva where click_product_id is not null group by 1, 2)
select * from (select *, row_number() over (partition by city_id order by clicks desc, product_id) as rank from c) where rank <= 3""")
def area_top_products(spark, sf):
    return traffic.area_top_products(b.user_visit_action(spark, sf))


WINDOWS = "select epoch(time_bucket(interval '1 hour', ts))::bigint begin_s, count(*) n, round(sum(value), 4) as value from events where event_type = 'click' group by 1"


def _windows(df: DataFrame) -> DataFrame:
    return df.select(F.unix_timestamp("begin").alias("begin_s"), "n", F.round("value", 4).alias("value"))


@query(WINDOWS)
def ad_clicks_windowed(spark, sf):
    return _windows(traffic.clicks_windowed(b.table(spark, sf, "events")))


@query(WINDOWS)
def ad_clicks_stream(spark, sf):
    """As a stream in update mode: each batch gives the windows that changed, which replace what was known of them."""
    root = shared_path(spark, "clicks")
    counts = traffic.clicks_windowed(streams.events_stream(spark, sf), late="1 hour")
    pipelines.upsert_stream(counts, f"{root}/windows", ["begin"], ["n"], mode="update")
    return _windows(pipelines.read_dim(spark, f"{root}/windows"))


TAGS = f"""{USERS},
tags as (
  select user_id, 'ATTRITUBE_U_01_001' tag_id, sex as value from users
  union all select user_id, 'ATTRITUBE_U_02_001', ((age // 10) * 10)::varchar from users
  union all select o_custkey, 'CONSUME_U_01_001', count(*)::varchar from orders where o_orderdate::date between date '1996-01-05' - 364 and date '1996-01-05' group by 1, 2 having count(*) > 2)"""


def _tags(spark, sf, day=DAY):
    orders = b.order_info(spark, sf)
    return portrait.attribute_tags(b.user_info(spark, sf), day).unionByName(portrait.active_consumers(orders, day, 365))


@query(f"with {TAGS} select *, '{DAY}' dt from tags")
def user_tags(spark, sf):
    return _tags(spark, sf)


@query(f"""with {TAGS} select user_id, '{DAY}' dt, max(value) filter (tag_id = 'ATTRITUBE_U_01_001') "ATTRITUBE_U_01_001", max(value) filter (tag_id = 'ATTRITUBE_U_02_001') "ATTRITUBE_U_02_001", max(value) filter (tag_id = 'CONSUME_U_01_001') "CONSUME_U_01_001" from tags group by 1""")
def user_tags_wide(spark, sf):
    return portrait.wide_tags(_tags(spark, sf), ["ATTRITUBE_U_01_001", "ATTRITUBE_U_02_001", "CONSUME_U_01_001"])


NEXT_DAY = "1996-01-06"
_TAGS_OF = {day: TAGS.replace(DAY, day).replace("tags as", f"tags{k} as").removeprefix(USERS + ",") for k, day in enumerate((DAY, NEXT_DAY))}
TAG_TABLES = f"""{USERS}, {_TAGS_OF[DAY]}, {_TAGS_OF[NEXT_DAY]},
inc as (select * from tags1 except select * from tags0),
tag_tables as (
  select 'increment' kind, *, '{NEXT_DAY}' dt from inc
  union all select 'full', * from (select *, '{NEXT_DAY}' from inc union all select *, '{DAY}' from tags0 where (user_id, tag_id) not in (select (user_id, tag_id) from inc)))"""


@query(f"with {TAG_TABLES} select * from tag_tables")
def user_tags_tables(spark, sf):
    """The full table of a day, the increment of the next day, and the full table after it."""
    before, now = _tags(spark, sf), _tags(spark, sf, NEXT_DAY)
    more = portrait.tag_increment(before, now)
    return more.withColumn("kind", F.lit("increment")).unionByName(portrait.tag_full(before, more).withColumn("kind", F.lit("full")))


@query("""
with d as (select max(ts::date) m from events)
select user_id, 'ACTION_U_01_001' tag_id, count(distinct ts::date)::varchar as value from events, d where ts::date between date '2024-01-07' - 6 and date '2024-01-07' group by 1""")
def user_active_days(spark, sf):
    return portrait.active_days(b.table(spark, sf, "events"), "2024-01-07").drop("dt")


@query("select o_orderkey \"oOrderkey\", o_orderstatus \"oOrderstatus\" from orders")
def camel_columns(spark, sf):
    from ..sources.io import camelize

    return camelize(b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


@query(f"""with {SESS.replace("from b)", "from b where sn % 30 between 0 and 14)")}, {USERS},
prof as (select sess.*, age, professional, city, sex from sess join users using (user_id)),
kept as (select * from prof where age between 10 and 45 and sex = 'male'),
d as (select * from uva where session_id in (select session_id from kept)),
ce as (
  select 'click' kind, click_category_id category_id from d where click_category_id is not null
  union all select 'order', unnest(string_split(order_category_ids, ','))::bigint from d
  union all select 'pay', unnest(string_split(pay_category_ids, ','))::bigint from d)
select category_id, count(*) filter (kind = 'click') click_count, count(*) filter (kind = 'order') order_count, count(*) filter (kind = 'pay') pay_count
from ce group by 1 order by 2 desc, 3 desc, 4 desc, 1 limit 10""")
def session_analysis_top10(spark, sf):
    from .session_analysis import session_analysis

    params = {"startDate": ["2024-01-01"], "endDate": ["2024-01-15"], "startAge": ["10"], "endAge": ["45"], "sex": ["male"]}
    return session_analysis(b.user_visit_action(spark, sf), b.user_info(spark, sf), params)["top10_category"]


JOB = f"""{SESS.replace("from b)", "from b where sn % 30 between 0 and 14)")}, {USERS},
prof as (select sess.*, age, professional, city, sex from sess join users using (user_id)),
kept as (select * from prof where age between 10 and 45 and sex = 'male'),
d as (select * from uva where session_id in (select session_id from kept)),
ce as (
  select 'click' kind, click_category_id category_id from d where click_category_id is not null
  union all select 'order', unnest(string_split(order_category_ids, ','))::bigint from d
  union all select 'pay', unnest(string_split(pay_category_ids, ','))::bigint from d),
top as (
  select category_id, count(*) filter (kind = 'click') a, count(*) filter (kind = 'order') o, count(*) filter (kind = 'pay') p from ce group by 1 order by 2 desc, 3 desc, 4 desc, 1 limit 10),
sc as (select session_id, click_category_id category_id, count(*) n from d where click_category_id is not null group by 1, 2),
best as (
  select * from (select *, row_number() over (partition by category_id order by n desc, session_id) as rank from sc where category_id in (select category_id from top)) where rank <= 10),
hours as (select replace(left(start_time, 13), ' ', '_') date_hour, count(*) n from kept group by 1),
hour_days as (select *, (sum(n) over (partition by left(date_hour, 10)))::bigint day_n from hours),
quota as (select date_hour, least(floor(n / day_n * floor(100 / (select count(distinct left(date_hour, 10)) from hours))), n) quota from hour_days),
ranked as (
  select session_id, date_hour, row_number() over (partition by date_hour order by md5('0_' || session_id), session_id) r
  from (select *, replace(left(start_time, 13), ' ', '_') date_hour from kept)),
extracted as (select session_id from ranked join quota using (date_hour) where r <= quota),
own as (
  select 'session_random_extract' as name, session_id from extracted
  union all select 'session_detail', session_id from d where session_id in (select session_id from extracted)
  union all select 'top10_category', null from top
  union all select 'top10_category_session', session_id from best
  union all select 'top10_session_detail', session_id from d join (select session_id from best) using (session_id)
  union all select 'session_aggr_stat', null)"""


@query(f"with {JOB} select name, count(*) n, count(distinct session_id) sessions, min(session_id) first_session, max(session_id) last_session from own group by 1")
def session_analysis_job(spark, sf):
    """The whole job writes its six tables for a task; of each the rows and sessions of the task."""
    from .session_analysis import run_session_analysis

    root = shared_path(spark, "session-analysis")
    params = {"startDate": ["2024-01-01"], "endDate": ["2024-01-15"], "startAge": ["10"], "endAge": ["45"], "sex": ["male"]}
    out = None
    for name in run_session_analysis(b.user_visit_action(spark, sf), b.user_info(spark, sf), params, root, 7):
        rows = spark.read.parquet(f"{root}/{name}").where("task_id = 7")
        session = F.col("session_id") if "session_id" in rows.columns else F.lit(None).cast("string")
        part = rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(session).alias("sessions"), F.min(session).alias("first_session"), F.max(session).alias("last_session"))
        out = part if out is None else out.unionByName(part)
    return out


_VALUES = ["user_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids"]
_VALUES_SQL = " || '|' || ".join(f"coalesce({c}::varchar, '')" for c in _VALUES)


@query(f"""with {JOB}
select 'session_random_extract' as name, session_id, date_hour as value from ranked join quota using (date_hour) where r <= quota
union all select 'session_detail', session_id, {_VALUES_SQL} from d where session_id in (select session_id from extracted)
union all select 'top10_category', null, category_id || '|' || a || '|' || o || '|' || p from top
union all select 'top10_category_session', session_id, category_id || '|' || n from best
union all select 'top10_session_detail', session_id, {_VALUES_SQL} from d join (select session_id from best) using (session_id)
union all select 'session_aggr_stat', null, count(*)::varchar from kept
union all select 'before', null, count(*)::varchar from prof union all select 'after', null, count(*)::varchar from kept""")
def session_analysis_rows(spark, sf):
    """The rows of the job's six tables, and the sessions before and after its filter as counted on the way."""
    from .session_analysis import run_session_analysis

    root, counts = shared_path(spark, "session-rows"), {}
    params = {"startDate": ["2024-01-01"], "endDate": ["2024-01-15"], "startAge": ["10"], "endAge": ["45"], "sex": ["male"]}
    run_session_analysis(b.user_visit_action(spark, sf), b.user_info(spark, sf), params, root, 7, counts=counts)
    all_of = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _VALUES])
    none = F.lit(None).cast("string")
    values = {
        "session_random_extract": ("session_id", F.col("date_hour")),
        "session_detail": ("session_id", all_of),
        "top10_category": (none, F.concat_ws("|", "category_id", "click_count", "order_count", "pay_count")),
        "top10_category_session": ("session_id", F.concat_ws("|", "category_id", "click_count")),
        "top10_session_detail": ("session_id", all_of),
        "session_aggr_stat": (none, F.col("session_count").cast("string")),
    }
    parts = [spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("name"), (F.col(s) if isinstance(s, str) else s).alias("session_id"), v.alias("value")) for name, (s, v) in values.items()]
    parts.append(spark.createDataFrame([(k, None, str(v)) for k, v in counts.items()], "name string, session_id string, value string"))
    return reduce(DataFrame.unionByName, parts)


FIRST_LOAD = "1996-01-04"


def _ods_base(name: str) -> tuple[str, str, str | None]:
    """The table of the data folder that stands in for a source table: its name, id and date columns."""
    if name.startswith("base_"):
        return "nation", "n_nationkey", None
    if name in ("sku_info", "spu_info"):
        return "part", "p_partkey", None
    return ("customer", "c_custkey", None) if name == "user_info" else ("orders", "o_orderkey", "o_orderdate")


def _ods_sql() -> str:
    each = []
    for name, spec in warehouse.ODS_SPECS.items():
        base, _, date = _ods_base(name)
        if spec.strategy == "O":
            each.append(f"select '{name}' as name, null dt, count(*) n from {base}")
            continue
        on_day = "true" if not spec.dates else f"{date}::date = date '{DAY}'" if date else "false"
        each.append(f"select '{name}' as name, dt, count(*) n from (select '{FIRST_LOAD}' dt from {base} union all select '{DAY}' from {base} where {on_day}) group by dt")
    return "select name, dt, n from (" + " union all ".join(each) + ")"


@query(_ods_sql())
def ods_all_tables(spark, sf):
    """All 23 source tables are imported and loaded, and a day later those that change: rows of each table and day."""
    root = shared_path(spark, "ods-all")

    def source(name: str) -> DataFrame:
        base, key, date = _ods_base(name)
        at = F.date_format(date, "yyyy-MM-dd HH:mm:ss") if date else F.lit(None).cast("string")
        return b.table(spark, sf, base).select(F.col(key).alias("id"), *[at.alias(c) for c in dict.fromkeys([*warehouse.ODS_SPECS[name].dates, "create_time"])])

    for mode, day in (("first", FIRST_LOAD), ("all", DAY)):
        warehouse.import_source(source, f"{root}/land", mode, day)
        warehouse.load_ods(spark, f"{root}/land", f"{root}/ods", mode, day)
    out = None
    for name, spec in warehouse.ODS_SPECS.items():
        rows = spark.read.parquet(f"{root}/ods/ods_{name}")
        day = (F.lit(None) if spec.strategy == "O" else F.col("dt")).cast("string").alias("dt")
        part = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "dt", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _ods_sources(spark, sf, root: str) -> Callable[[str], DataFrame]:
    """The source tables, with values in their key, name, date and amount columns.

    Keys and dates of the orders, which stand in for most of them, are written once: times are text in a
    source table, and need not be made of a date anew for each table and day.
    """
    key, date = _ods_base("order_info")[1:]
    orders = b.table(spark, sf, "orders").select(key, F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias(date))
    orders.write.option("maxRecordsPerFile", 500_000).parquet(f"{root}/orders")  # so many tasks can read it

    def source(name: str) -> DataFrame:
        base, key, date = _ods_base(name)
        spec = warehouse.ODS_SPECS[name]
        at = F.col(date) if date else F.lit(None).cast("string")
        own = {c: at for c in dict.fromkeys([*spec.dates, "create_time"])}
        for k, (c, t) in enumerate(spec.columns.items()):
            if c not in own:
                own[c] = F.col(key) if k == 0 else F.col(key) % (k + 2) if t != "string" else F.when(F.col(key) % (k + 3) > 0, F.concat(F.lit(f" {c}\t\\\t"), F.col(key).cast("string")))
        return (spark.read.parquet(f"{root}/orders") if date else b.table(spark, sf, base)).select(*[v.alias(c) for c, v in own.items()])

    return source


def _ods_values_sql() -> str:
    each = []
    for name, spec in warehouse.ODS_SPECS.items():
        base, key, date = _ods_base(name)
        at = f"strftime({date}, '%Y-%m-%d %H:%M:%S')" if date else "null::varchar"
        values = []
        for k, (c, t) in enumerate(spec.columns.items()):
            if c in (*spec.dates, "create_time"):
                values.append(at)
            else:
                values.append(f"{key}::{t}" if k == 0 else f"({key} % {k + 2})::{t}" if t != "string" else f"case when {key} % {k + 3} > 0 then concat(' {c}', chr(9), chr(92), chr(9), {key}) end")
        row = " || '|' || ".join(f"coalesce(({v.replace('::string', '::varchar')})::varchar, '\\N')" for v in values)
        on_day = "true" if not spec.dates else f"{date}::date = date '{DAY}'" if date else "false"
        days = [("null", "true")] if spec.strategy == "O" else [(f"'{FIRST_LOAD}'", "true"), (f"'{DAY}'", on_day)]
        each += [f"select '{name}' as name, {day}::varchar dt, count(*) n, bit_xor(('0x' || left(md5({row}), 15))::bigint) as hash from {base} where {where} group by 1, 2" for day, where in days]
    return "select name, dt, n, hash from (" + " union all ".join(each) + ")"


@query(_ods_values_sql())
def ods_all_values(spark, sf):
    """The 23 tables of two days, with tabs and backslashes in their values: of each table and day the rows and a hash of all columns."""
    root = shared_path(spark, "ods-values")
    source = _ods_sources(spark, sf, f"{root}/source")
    for mode, day in (("first", FIRST_LOAD), ("all", DAY)):
        warehouse.import_source(source, f"{root}/land", mode, day)
        warehouse.load_ods(spark, f"{root}/land", f"{root}/ods", mode, day)
    out = []
    for name, spec in warehouse.ODS_SPECS.items():
        rows = spark.read.parquet(f"{root}/ods/ods_{name}")
        day = (F.lit(None) if spec.strategy == "O" else F.col("dt")).cast("string").alias("dt")
        row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in spec.columns])
        part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
        out.append(rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(part).alias("hash")).select(F.lit(name).alias("name"), "dt", "n", "hash"))
    return reduce(DataFrame.unionByName, out)


_ODD_SQL = "[chr(9), chr(10) || 'x' || chr(10), chr(13) || chr(10), chr(92) || 'N', '  sp ', '', null, 'a' || chr(92), chr(92) || 'n' || chr(92) || chr(92) || chr(10), '日本'][o_orderkey % 10 + 1]"


@query(f"""
select o_orderkey::varchar id, {_ODD_SQL} as name, md5(coalesce(text, 'null')) as text
from orders left join documents on doc_id = o_orderkey""")
def ods_odd_values(spark, sf):
    """Values with tabs, line ends, backslashes, blanks, a literal null mark, and whole texts come back as they were."""
    root = shared_path(spark, "ods-odd")
    odd = F.array(*[F.lit(x) for x in ("\t", "\nx\n", "\r\n", "\\N", "  sp ", "", None, "a\\", "\\n\\\\\n", "日本")])
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"), "text")
    own = b.table(spark, sf, "orders").join(docs, "o_orderkey", "left").select(F.col("o_orderkey").cast("string").alias("id"), F.get(odd, (F.col("o_orderkey") % 10).cast("int")).alias("name"), F.col("text").alias("category2_id"))
    warehouse.land(own, root, "base_category3", DAY)
    found = warehouse.read_landed(spark, root, "base_category3", DAY)
    return found.select("id", "name", F.md5(F.coalesce("category2_id", F.lit("null"))).alias("text"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, aggregate, join, filter and count in one plan: the histogram of filtered sessions."""
    own = sessions.scan_actions(b.user_visit_action(spark, sf), "2024-01-01", "2024-01-31")
    profiles = sessions.session_profiles(sessions.aggregate_sessions(own), b.user_info(spark, sf))
    return sessions.session_stats(sessions.filter_sessions(profiles, {"startAge": ["10"], "endAge": ["50"]}))
