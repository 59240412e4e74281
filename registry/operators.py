"""One query per operator, straight over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from registry import Tables, layer_path, query
from tidemart.functions import times
from tidemart.functions.values import product_text
from tidemart.operators import serve
from tidemart.operators.bounce import bounces
from tidemart.operators.changes import became, change_events, changed, positive_delta
from tidemart.operators.dedup import first_per_day, first_per_key, latest_per_key
from tidemart.operators.enrich import enrich, lookup
from tidemart.operators.hotkeys import attach_per_key
from tidemart.operators.joins import bounded_join, interval_join
from tidemart.operators.keywords import keyword_counts, words
from tidemart.operators.routing import route_dimensions
from tidemart.operators.sets import union_all
from tidemart.operators.visitors import (
    daily_visits, first_flags, is_first_ever, is_returning, repair_is_new,
)
from tidemart.operators.windows import sums, to_metrics, tumble, tumble_distinct
from tidemart.plans.traffic import fan_out_raw_logs
from tidemart.schemas import DIM_CONFIG
from registry import feeds
from tidemart.sources.connectors import read_summary, store_summary
from tidemart.sources.text import parse_changes, parse_json


def _r2(name: str):
    return F.round(name, 2).alias(name)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(_r2(c) if c in names else c for c in df.columns))


# --- parse, project, filter, route ---------------------------------------------------------------


@query("""
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       '{"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' AS rebuilt
FROM events
""")
def json_extract_project(t: Tables) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    good, _ = parse_json(t.events.select("event_id", "event_type", "props"), "props", schema, ("event_id", "event_type"))
    return good.select(
        "event_id", "event_type", "k",
        F.to_json(F.struct(F.col("k"), F.col("event_type").alias("kind"))).alias("rebuilt"),
    )


@query("""
SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 12345678901230 AS VARCHAR) AS large, o_orderkey % 2 = 0 AS quoted_time,
       o_orderkey * 1000 AS ts
FROM orders
""")
def payload_decimals(t: Tables) -> DataFrame:
    """Bare decimals keep their digits in payload text; keys repeat, and every other time is quoted."""
    even = F.col("o_orderkey") % 2 == 0
    price = F.col("o_totalprice").cast("decimal(18,2)")
    mark = F.when(even, '"').otherwise("")
    value = F.concat(
        F.lit('{"database":"shop","table":"order_info","type":"x","type":"insert","ts":'), mark, (F.col("o_orderkey") * 1000).cast("string"), mark,
        F.lit(',"data":{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"note":"costs: 1.50, or \\"2.50\\",","amount":'), price.cast("string"),
        F.lit(',"large":'), (price + F.lit(12345678901230).cast("decimal(18,0)")).cast("string"), F.lit("}}"),
    )
    rows = parse_changes(t.orders.select(value.alias("value"))).filter(
        (F.col("type") == "insert") & (F.col("data")["note"] == 'costs: 1.50, or "2.50",')
    )
    return rows.select(
        F.col("data")["id"].cast("bigint").alias("id"), F.col("data")["amount"].alias("amount"), F.col("data")["large"].alias("large"),
        (F.col("data")["id"].cast("bigint") % 2 == 0).alias("quoted_time"), "ts",
    )


@query("""
WITH v AS (
  SELECT CASE WHEN event_type = 'error' THEN left(props, length(props) - 1)
              WHEN event_type = 'signup' THEN '[' || props || ']'
              ELSE props END AS value
  FROM events
  UNION ALL SELECT text FROM documents
)
SELECT CASE WHEN json_valid(value) AND left(value, 1) = '{' THEN 'good' ELSE 'dirty' END AS kind,
       count(*) AS n
FROM v WHERE trim(value) <> '' GROUP BY 1
""")
def dirty_split_counts(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    broken = (
        F.when(kind == "error", F.expr("left(props, length(props) - 1)"))
        .when(kind == "signup", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.col("props"))
    )
    values = union_all(t.events.select(broken.alias("value")), t.documents.select(F.col("text").alias("value")))
    good, dirty = parse_json(values, "value", T.StructType([T.StructField("k", T.IntegerType())]))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return union_all(count(good, "good"), count(dirty, "dirty")).filter("n > 0")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, '1003' AS order_status,
       strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS absent
FROM orders WHERE o_orderstatus = 'F'
""")
def change_event_filter(t: Tables) -> DataFrame:
    changes = parse_changes(feeds.order_text(t.orders, ["placed", "status"]))
    rows = change_events(
        changes, "order_info",
        {"id": "id", "user_id": "user_id", "order_status": "order_status", "time": "operate_time", "absent": "no_such_field"},
        ["update"], feeds.DATABASE, where=changed("order_status") & became("order_status", "1003", "1001"),
    )
    return rows.select("id", "user_id", "order_status", times.date_prefix("time").alias("day"), "absent")


@query("""
SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN k ELSE k - CAST(floor(value) AS BIGINT) END AS added
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
WHERE event_type = 'click' OR (event_type = 'purchase' AND k > floor(value))
""")
def cart_delta(t: Tables) -> DataFrame:
    changes = parse_changes(feeds.event_text(t.events, ["cart"], ["event_id", "event_type"]), keep=("event_id", "event_type"))
    return positive_delta(changes, "sku_num", out="added").select(
        "event_id", "event_type", F.col("added").cast("bigint").alias("added")
    )


@query("""
WITH l AS (SELECT event_type AS kind, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
o AS (
  SELECT 'error' AS record, ms FROM l WHERE kind = 'error'
  UNION ALL SELECT 'start', ms FROM l WHERE kind = 'error' AND k < 30
  UNION ALL SELECT 'page', ms FROM l WHERE NOT (kind = 'error' AND k < 30)
  UNION ALL SELECT 'action', ms FROM l WHERE kind = 'purchase'
  UNION ALL SELECT 'display', ms FROM l WHERE kind = 'view'
  UNION ALL SELECT 'display', ms FROM l WHERE kind = 'view'
)
SELECT record, count(*) AS n, CAST(sum(ms - 1704067200000) AS BIGINT) AS ms_sum FROM o GROUP BY record
""")
def log_fanout_counts(t: Tables) -> DataFrame:
    rows = fan_out_raw_logs(feeds.log_text(t.events)).select(
        "record", F.get_json_object("value", "$.ts").cast("bigint").alias("ts")
    )
    return rows.groupBy("record").agg(
        F.count("*").alias("n"), F.sum(F.col("ts") - 1704067200000).alias("ms_sum")
    )


@query("""
SELECT 'dim_region' AS sink_table, 'id' AS sink_pk, CAST(r_regionkey AS VARCHAR) AS pk, 'id=' || r_regionkey || ',name=' || r_name AS kept FROM region
UNION ALL
SELECT 'dim_nation', 'id', CAST(n_nationkey AS VARCHAR), 'id=' || n_nationkey || ',name=' || n_name || ',region_id=' || n_regionkey FROM nation
UNION ALL
SELECT 'dim_supplier', 'supp_id', CAST(s_suppkey AS VARCHAR), 'name=' || s_name || ',supp_id=' || s_suppkey FROM supplier
""")
def config_column_route(t: Tables) -> DataFrame:
    config = t.spark.createDataFrame(
        [
            ("region", "dim_region", "id,name", None, None),
            ("nation", "dim_nation", "id,name,region_id", "", None),
            ("supplier", "dim_supplier", "supp_id,name", "supp_id", "ignored"),
        ],
        DIM_CONFIG,
    )
    raw = union_all(
        feeds.table_text(t.region, "region", {"id": "r_regionkey", "name": "r_name"}),
        feeds.table_text(t.nation, "nation", {"id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"}),
        feeds.table_text(t.supplier, "supplier", {"supp_id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"}),
        feeds.table_text(t.customer, "customer", {"id": "c_custkey"}),
    )
    routed = route_dimensions(parse_changes(raw), config)
    entries = F.transform(
        F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return routed.select(
        "sink_table", "sink_pk", F.col("data")[F.col("sink_pk")].alias("pk"), F.array_join(entries, ",").alias("kept")
    )


# --- keyed rules ---------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN '1' ELSE '0' END AS is_new FROM events),
f AS (
  SELECT *, first_value(is_new) OVER w AS first_flag, CAST(first_value(ts) OVER w AS DATE) AS first_date
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
SELECT event_id, user_id,
       CASE WHEN is_new = '1' AND CAST(ts AS DATE) <> CASE WHEN first_flag = '1' THEN first_date ELSE first_date - 1 END
            THEN '0' ELSE is_new END AS is_new
FROM f
""")
def visitor_type_repair(t: Tables) -> DataFrame:
    flagged = t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", "1").otherwise("0").alias("is_new")
    )
    return repair_is_new(flagged, "user_id", "ts", "is_new", ["event_id"]).select("event_id", "user_id", "is_new")


@query("""
SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1
""")
def daily_unique_first(t: Tables) -> DataFrame:
    slim = t.events.select("event_id", "ts", "user_id", "event_type")
    return first_per_day(slim, ["user_id"], "ts", ["event_id"]).select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("day")
    )


@query("""
SELECT o_orderkey, o_custkey,
       CAST(row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1 AS BIGINT) AS is_unique,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS BIGINT) AS is_new_user
FROM orders
""")
def first_and_daily_flags(t: Tables) -> DataFrame:
    slim = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return first_flags(slim, "o_custkey", "o_orderdate", ["o_orderkey"]).drop("o_orderdate")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate AS day FROM orders),
f AS (SELECT day, lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS prev FROM d),
u AS (SELECT day, count(*) AS uu, count(*) FILTER (prev IS NULL) AS nn FROM f GROUP BY day),
a AS (SELECT o_orderdate AS day, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d 00:00:00') AS stt, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d 00:00:00') AS edt,
       uu AS order_unique_user_count, nn AS order_new_user_count, amount AS order_amount
FROM u JOIN a USING (day)
""")
def first_order_daily_sums(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", F.col("o_orderdate").alias("rt"), "o_totalprice")
    users = ("order_unique_user_count", "order_new_user_count")
    money = to_metrics(orders, "rt", {}, {**dict.fromkeys(users, 0), "order_amount": F.col("o_totalprice")})
    buyers = to_metrics(
        daily_visits(orders, "o_custkey", "rt"), "rt", {},
        {users[0]: 1, users[1]: is_first_ever(), "order_amount": F.lit(0.0)},
    )
    out = tumble(union_all(money, buyers), "rt", "1 day", sums(*users, "order_amount"), version=False)
    return _rounded(out, "order_amount")


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
f AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM d)
SELECT strftime(day, '%Y-%m-%d 00:00:00') AS stt, strftime(day + 1, '%Y-%m-%d 00:00:00') AS edt,
       CAST(sum(CASE WHEN day - prev > 7 THEN 1 ELSE 0 END) AS BIGINT) AS back_ct, count(*) AS uu_ct
FROM f GROUP BY day
""")
def returning_users(t: Tables) -> DataFrame:
    logins = t.events.filter(F.col("event_type") == "signup").select("user_id", "ts")
    rows = to_metrics(daily_visits(logins, "user_id", "ts"), "ts", {}, {"back_ct": is_returning(), "uu_ct": 1})
    return tumble(rows, "rt", "1 day", sums("back_ct", "uu_ct"), version=False)


_LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
_LINE_SQL = ", ".join(_LINE_ORDER)
_LINE_DESC = ", ".join(f"{c} DESC" for c in _LINE_ORDER)


@query(f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_SQL}) = 1
""")
def dedup_first_by_key(t: Tables) -> DataFrame:
    return first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], _LINE_ORDER)


@query(f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_DESC}) = 1
""")
def dedup_latest_by_key(t: Tables) -> DataFrame:
    return latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], _LINE_ORDER)


@query("""
WITH n AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM n
WHERE event_type = 'view'
  AND (next_ts IS NULL OR epoch_us(next_ts) - epoch_us(ts) >= 7200000000 OR next_type = 'view')
""")
def bounce_detail(t: Tables) -> DataFrame:
    hit = bounces(
        t.events.select("event_id", "ts", "user_id", "event_type", "props"), "user_id", "ts",
        F.col("event_type") == "view", within_seconds=7200, order=["event_id"], bucket_seconds=86400,
    )
    return hit.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# --- windows -------------------------------------------------------------------------------------

_BUCKET = """strftime(b, '%Y-%m-%d %H:%M:%S') AS stt, strftime(b + INTERVAL '{0}', '%Y-%m-%d %H:%M:%S') AS edt"""


@query(f"""
SELECT {_BUCKET.format('10 minutes')}, count(*) AS event_ct, round(sum(value), 2) AS value_sum
FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) AS b, value FROM events) GROUP BY b
""")
def tumbling_global_sum(t: Tables) -> DataFrame:
    rows = to_metrics(t.events, "ts", {}, {"event_ct": 1, "value_sum": F.col("value")})
    return _rounded(tumble(rows, "rt", "10 minutes", sums("event_ct", "value_sum"), version=False), "value_sum")


@query(f"""
WITH n AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), m AS (
  SELECT ts, event_type, 0 AS uv, CAST(event_type = 'view' AS INT) AS sv, 1 AS pv, CAST(json_extract(props, '$.k') AS BIGINT) AS dur, 0 AS uj FROM events
  UNION ALL
  SELECT ts, event_type, 1, 0, 0, 0, 0 FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view') WHERE rn = 1
  UNION ALL
  SELECT ts, event_type, 0, 0, 0, 0, 1 FROM n
  WHERE event_type = 'view' AND (next_ts IS NULL OR epoch_us(next_ts) - epoch_us(ts) >= 7200000000 OR next_type = 'view')
)
SELECT {_BUCKET.format('1 hour')}, event_type, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct,
       CAST(sum(pv) AS BIGINT) AS pv_ct, CAST(sum(dur) AS BIGINT) AS dur_sum, CAST(sum(uj) AS BIGINT) AS uj_ct
FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, * FROM m) GROUP BY b, event_type
""")
def tumbling_keyed_multi_metric(t: Tables) -> DataFrame:
    names = ("uv_ct", "sv_ct", "pv_ct", "dur_sum", "uj_ct")
    entry = F.col("event_type") == "view"

    def rows(df: DataFrame, **metrics) -> DataFrame:
        return to_metrics(df, "ts", {"event_type": "event_type"}, {**dict.fromkeys(names, 0), **metrics})

    slim = t.events.select("event_id", "ts", "user_id", "event_type", "props")
    plain = slim.drop("props")
    all_rows = union_all(
        rows(slim, sv_ct=entry.cast("bigint"), pv_ct=1, dur_sum=F.get_json_object("props", "$.k").cast("bigint")),
        rows(first_per_day(plain.filter(entry), ["user_id"], "ts", ["event_id"]), uv_ct=1),
        rows(bounces(plain, "user_id", "ts", entry, 7200, ["event_id"], 86400), uj_ct=1),
    )
    return tumble(all_rows, "rt", "1 hour", sums(*names), ["event_type"], version=False)


@query(f"""
SELECT {_BUCKET.format('1 day')}, province_id, n_name AS province_name, order_count, order_amount FROM (
  SELECT o_orderdate AS b, c_nationkey AS province_id, count(DISTINCT o_orderkey) AS order_count, round(sum(o_totalprice), 2) AS order_amount
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
) LEFT JOIN nation ON province_id = n_nationkey
""")
def province_order_window(t: Tables) -> DataFrame:
    newest = latest_per_key(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), ["o_orderkey"], ["o_orderdate", "o_totalprice", "o_custkey"]
    )
    placed = enrich(newest, t.customer, "o_custkey", {"c_nationkey": "province_id"}, "c_custkey")
    summed = tumble_distinct(
        placed.withColumnRenamed("o_totalprice", "order_amount"), "o_orderdate", "1 day", "o_orderkey", "order_count",
        ["order_amount"], ["province_id"], version=False,
    )
    named = enrich(summed, t.nation, "province_id", {"n_name": "province_name"}, "n_nationkey")
    return _rounded(named, "order_amount").select("stt", "edt", "province_id", "province_name", "order_count", "order_amount")


@query(f"""
SELECT {_BUCKET.format('1 day')}, user_id, trademark, g.nation_id, n_name AS nation_name, r_name AS region_name, order_count, order_amount FROM (
  SELECT o_orderdate AS b, o_custkey AS user_id, p_brand AS trademark, s_nationkey AS nation_id,
         count(DISTINCT o_orderkey) AS order_count, round(sum(l_extendedprice), 2) AS order_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3, 4
) g LEFT JOIN nation ON g.nation_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def user_spu_order_window(t: Tables) -> DataFrame:
    placed = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("order_amount"))
    rows = bounded_join(lines, placed, [("l_orderkey", "o_orderkey")])
    rows = enrich(rows, t.part, "l_partkey", {"p_brand": "trademark"}, "p_partkey")
    rows = enrich(rows, t.supplier, "l_suppkey", {"s_nationkey": "nation_id"}, "s_suppkey")
    summed = tumble_distinct(
        rows, "o_orderdate", "1 day", "o_orderkey", "order_count", ["order_amount"],
        ["user_id", "trademark", "nation_id"], version=False,
    )
    named = enrich(summed, _nation_tree(t), "nation_id", {"n_name": "nation_name", "r_name": "region_name"}, "n_nationkey")
    return _rounded(named, "order_amount").select(
        "stt", "edt", "user_id", "trademark", "nation_id", "nation_name", "region_name", "order_count", "order_amount"
    )


def _nation_tree(t: Tables) -> DataFrame:
    return enrich(t.nation, t.region, "n_regionkey", {"r_name": "r_name"}, "r_regionkey")


@query(f"""
SELECT {_BUCKET.format('1 day')}, user_id, trademark, kind, refund_count FROM (
  SELECT l_shipdate AS b, o_custkey AS user_id, p_brand AS trademark, p_type AS kind, count(DISTINCT o_orderkey) AS refund_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag = 'R' GROUP BY 1, 2, 3, 4)
""")
def refund_window(t: Tables) -> DataFrame:
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_partkey", "l_shipdate")
    rows = bounded_join(
        returned, t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id")), [("l_orderkey", "o_orderkey")]
    )
    rows = enrich(rows, t.part, "l_partkey", {"p_brand": "trademark", "p_type": "kind"}, "p_partkey")
    return tumble_distinct(
        rows, "l_shipdate", "1 day", "o_orderkey", "refund_count", (), ["user_id", "trademark", "kind"], version=False
    )


# --- joins ---------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date_id,
       CAST(CAST(l_quantity AS DECIMAL(16,2)) * CAST(l_extendedprice AS DECIMAL(16,2)) AS VARCHAR) AS split_original_amount,
       a.quality AS activity, c.item_id AS coupon, n_name AS source_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN labels a ON l_partkey = a.doc_id
LEFT JOIN benchmark c ON l_suppkey = c.item_id
JOIN nation ON l_suppkey % 30 = n_nationkey
""")
def order_preprocess_join(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.col("l_quantity").cast("string").alias("num"), F.col("l_extendedprice").cast("string").alias("price"),
        (F.col("l_suppkey") % feeds.CODES).cast("string").alias("source"),
    )
    lines = lookup(lines, feeds.dictionary_of(t.nation, "n_nationkey", "n_name"), "source", "source_name")
    joined = bounded_join(lines, t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), [("l_orderkey", "o_orderkey")])
    # Labels and benchmark items cover some of the numbers only, so both joins leave rows unmatched.
    joined = bounded_join(joined, t.labels.select("doc_id", F.col("quality").alias("activity")), [("l_partkey", "doc_id")], "left")
    joined = bounded_join(joined, t.benchmark.select("item_id", F.col("item_id").alias("coupon")), [("l_suppkey", "item_id")], "left")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "o_custkey",
        F.date_format("o_orderdate", times.DAY).alias("date_id"), product_text("num", "price").alias("split_original_amount"),
        "activity", "coupon", "source_name",
    )


@query("""
WITH p AS (SELECT l_orderkey, l_partkey, count(*) AS line_ct, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, o_custkey, line_ct, quantity
FROM lineitem l JOIN p ON l.l_orderkey = p.l_orderkey AND l.l_partkey = p.l_partkey JOIN orders ON l.l_orderkey = o_orderkey
WHERE l_returnflag = 'R'
""")
def multi_key_join(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey"]
    asked = t.lineitem.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.count("*").alias("line_ct"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )
    payouts = t.lineitem.filter(F.col("l_returnflag") == "R").select(
        *keys, "l_linenumber", "l_suppkey", "l_shipdate"
    )
    rows = attach_per_key(payouts, asked, keys, "__n")
    return bounded_join(rows, t.orders.select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")]).drop("o_orderkey")


@query("""
SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS line_ct
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
GROUP BY 1, 2
""")
def double_dictionary_join(t: Tables) -> DataFrame:
    rows = bounded_join(t.lineitem.select("l_orderkey", "l_suppkey"), t.orders.select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")])
    rows = enrich(rows, t.customer, "o_custkey", {"c_nationkey": "c_code"}, "c_custkey", "inner")
    rows = enrich(rows, t.supplier, "l_suppkey", {"s_nationkey": "s_code"}, "s_suppkey", "inner")
    # Codes repeat far more often than names are wanted: count per code pair, then name the pairs.
    pairs = rows.groupBy(F.col("c_code").cast("string").alias("c_code"), F.col("s_code").cast("string").alias("s_code")).agg(
        F.count("*").alias("line_ct")
    )
    dictionary = feeds.dictionary_of(t.nation, "n_nationkey", "n_name")
    named = lookup(lookup(pairs, dictionary, "c_code", "customer_nation"), dictionary, "s_code", "supplier_nation")
    return named.select("customer_nation", "supplier_nation", "line_ct")


@query("""
SELECT c.event_id AS click_id, p.event_id AS purchase_id, c.user_id, epoch_us(p.ts) - epoch_us(c.ts) AS gap_us
FROM events c JOIN events p ON c.user_id = p.user_id
 AND p.ts >= c.ts - INTERVAL 10 MINUTE AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'
""")
def interval_join_click_purchase(t: Tables) -> DataFrame:
    clicks = t.events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts")
    )
    buys = t.events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts")
    )
    near = interval_join(clicks, buys, [("user_id", "buyer")], "click_ts", "buy_ts", -600, 3600)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return near.select("click_id", "purchase_id", "user_id", (micros("buy_ts") - micros("click_ts")).alias("gap_us"))


@query("""
WITH c AS (SELECT event_id AS click_id, user_id, ts FROM events WHERE event_type = 'click'),
p AS (SELECT event_id AS purchase_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT click_id, purchase_id FROM c FULL JOIN p
ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 12 HOUR
""")
def interval_join_full(t: Tables) -> DataFrame:
    clicks = t.events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts")
    )
    buys = t.events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts")
    )
    near = interval_join(clicks, buys, [("user_id", "buyer")], "click_ts", "buy_ts", 0, 12 * 3600, "full")
    return near.select("click_id", "purchase_id")


def _variant(how: str) -> str:
    return (
        f"SELECT '{how}' AS how, count(*) AS n, count(page_id) AS pages, count(doc_id) AS labels, "
        f"CAST(sum(doc_id) AS BIGINT) AS key_sum FROM pages {how} JOIN labels ON page_id = doc_id"
    )


_HOWS = ("inner", "left", "right", "full")


@query(
    " UNION ALL ".join(_variant(h) for h in _HOWS)
)
def outer_join_variants(t: Tables) -> DataFrame:
    """Two whole tables whose numbers overlap in part, so every kind of join has unmatched rows."""
    pages, labels = t.pages.select("page_id"), t.labels.select("doc_id")
    return union_all(
        *(
            bounded_join(pages, labels, [("page_id", "doc_id")], how).agg(
                F.count("*").alias("n"), F.count("page_id").alias("pages"), F.count("doc_id").alias("labels"), F.sum("doc_id").alias("key_sum"),
            ).select(F.lit(how).alias("how"), "n", "pages", "labels", "key_sum")
            for how in _HOWS
        )
    )


# --- keywords, dashboards, functions -------------------------------------------------------------

IDEOGRAPHS = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}]"


@query(f"""
SELECT {_BUCKET.format('10 minutes')}, 'search' AS source, keyword, count(*) AS keyword_count FROM (
  SELECT time_bucket(INTERVAL '10 minutes', TIMESTAMP '2024-01-01' + to_seconds(doc_id)) AS b,
         unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS keyword
  FROM documents)
WHERE keyword <> '' GROUP BY b, keyword
""")
def keyword_window_count(t: Tables) -> DataFrame:
    typed = t.documents.select(
        "text", times.from_millis_floor(F.lit(1704067200000) + F.col("doc_id") * 1000).alias("rt")
    )
    return keyword_counts(typed, "text", "rt", "10 minutes", version=False)


@query(f"""
WITH dict AS (
  SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark) WHERE word <> ''),
runs AS (
  SELECT row_number() OVER () AS id, b, run FROM (
    SELECT time_bucket(INTERVAL '10 minutes', TIMESTAMP '2024-01-01' + to_seconds(doc_id)) AS b,
           unnest(regexp_split_to_array(lower(replace(text, ' ', '')), '[^\\p{{L}}\\p{{N}}]+')) AS run FROM documents)
  WHERE run <> ''),
places AS (SELECT id, b, run, unnest(range(1, length(run) + 1)) AS p FROM runs),
pieces AS (SELECT id, b, p, n, substring(run, p, n) AS word, length(run) AS size FROM places, (SELECT DISTINCT length(word) AS n FROM dict)),
hits AS (SELECT id, b, p, n, word FROM pieces JOIN dict USING (word) WHERE p + n <= size + 1),
covered AS (SELECT DISTINCT id, unnest(range(p, p + n)) AS p FROM hits),
free AS (
  SELECT id, b, p, substring(run, p, 1) AS c, p - row_number() OVER (PARTITION BY id, regexp_matches(substring(run, p, 1), '{IDEOGRAPHS}') ORDER BY p) AS island,
         regexp_matches(substring(run, p, 1), '{IDEOGRAPHS}') AS alone
  FROM places ANTI JOIN covered USING (id, p)),
left_over AS (SELECT b, string_agg(c, '' ORDER BY p) AS word FROM free GROUP BY id, b, island, alone, CASE WHEN alone THEN p END)
SELECT {_BUCKET.format('10 minutes')}, 'search' AS source, word AS keyword, count(*) AS keyword_count
FROM (SELECT b, word FROM hits UNION ALL SELECT b, word FROM left_over) GROUP BY b, word
""")
def keyword_segment_window(t: Tables) -> DataFrame:
    """Documents with their spaces taken out, cut by the words of the benchmark items."""
    typed = t.documents.select(
        F.replace("text", F.lit(" "), F.lit("")).alias("text"),
        times.from_millis_floor(F.lit(1704067200000) + F.col("doc_id") * 1000).alias("rt"),
    )
    return keyword_counts(typed, "text", "rt", "10 minutes", version=False, dictionary=words(t.benchmark, "text"))


@query("""
SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day, round(sum(o_totalprice), 2) AS order_amount
FROM orders GROUP BY 1
""")
def gmv_by_day(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy(times.day_number("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("order_amount"))
        .select("day", _r2("order_amount"))
    )


@query("""
SELECT round(sum(o_totalprice), 2) AS order_amount FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'
""")
def gmv_one_day(t: Tables) -> DataFrame:
    """Read off a summary of order amounts per second, stored by day."""

    def write(path: str) -> None:
        rows = tumble(t.orders, "o_orderdate", "1 second", {"order_amount": F.sum("o_totalprice")})
        store_summary(rows, path)

    summary = read_summary(t.spark, layer_path(t, "summary-orders", write), date=19981003)
    return serve.gmv(summary, 19981003).select(_r2("order_amount"))


def _channels(t: Tables, date: int) -> DataFrame:
    """A day of the stored summary of hourly visitors per channel, a device counting once a day in each."""
    slim = t.events.select("event_id", "ts", "user_id", F.col("event_type").alias("ch"))
    firsts = slim.groupBy("ch", "user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("rt"))
    rows = firsts.select("ch", "rt", F.lit(1).cast("bigint").alias("uv_ct"))
    path = layer_path(t, "summary-channels", lambda p: store_summary(tumble(rows, "rt", "1 hour", sums("uv_ct"), ["ch"]), p))
    return read_summary(t.spark, path, ["ch"], date)


_TOP = """
WITH f AS (SELECT event_type AS ch, user_id, min(ts) AS ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1, 2),
h AS (SELECT ch, time_bucket(INTERVAL '1 hour', ts) AS b, count(*) AS uv_ct FROM f GROUP BY 1, 2),
top AS (SELECT ch, CAST(sum(uv_ct) AS BIGINT) AS uv, count(*) AS ct FROM h GROUP BY ch ORDER BY uv DESC, ch LIMIT 3)
"""


@query(_TOP + "SELECT ch, uv, ct FROM top")
def uv_topn_by_channel(t: Tables) -> DataFrame:
    return serve.uv_by_channel(_channels(t, 20240115), 20240115, 3)


@query(_TOP + """
SELECT '{"status":0,"msg":"","data":{"categories":["' || string_agg(ch, '","' ORDER BY uv DESC, ch)
       || '"],"series":[{"name":"日活","data":[' || string_agg(CAST(uv AS VARCHAR), ',' ORDER BY uv DESC, ch) || ']}]}}' AS payload
FROM top
""")
def dashboard_payload(t: Tables) -> DataFrame:
    return serve.uv_payload(serve.uv_by_channel(_channels(t, 20240115), 20240115, 3))


@query("""
SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS full_text,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 AS parsed_ms,
       CAST(epoch(date_trunc('day', ts)) AS BIGINT) * 1000 AS day_ms,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS floor_s, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_number
FROM events
""")
def time_format_functions(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", "ts", ms.alias("ms"))
    text = times.millis_to_full("ms")
    return rows.select(
        "event_id", "ms", times.millis_to_day("ms").alias("day"), text.alias("full_text"),
        times.to_millis(text).alias("parsed_ms"), times.to_millis(times.date_prefix(text), full=False).alias("day_ms"),
        F.unix_seconds(times.from_millis_floor("ms")).alias("floor_s"), times.day_number("ts").alias("day_number"),
    )
