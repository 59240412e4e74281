"""Summary-layer jobs over the detail layer, and the dashboards over the summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from registry import Tables, layer_path, query
from registry.dwd import (
    CARTS, LINES, LOGS, PAID, PLACED, REFUNDS, bounce_rows, carts, page_logs, paid_lines, pre_processed, refunds,
    registers, visitor_rows,
)
from tidemart.plans import dashboard, tools, trade, traffic
from tidemart.sources.connectors import read_summary, store_summary

_SPAN = """strftime(b, '%Y-%m-%d %H:%M:%S') AS stt, strftime(b + INTERVAL '{0}', '%Y-%m-%d %H:%M:%S') AS edt"""


def _b(size: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{size}', {ts}) AS b"


def _money(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 2).alias(c) if c in names else c for c in df.columns))


# --- traffic -------------------------------------------------------------------------------------


@query(f"""
WITH {LOGS}
SELECT {_SPAN.format('10 minutes')}, 'search' AS source, keyword, count(*) AS keyword_count FROM (
  SELECT {_b('10 minutes')}, unnest(['word' || (k % 10), 'item' || (k % 3)]) AS keyword FROM pages WHERE kind = 'click')
GROUP BY b, keyword
""")
def rollup_keyword_window(t: Tables) -> DataFrame:
    return traffic.keyword_window(page_logs(t), "10 minutes", version=False)


_CHANNEL_ROWS = """
m AS (
  SELECT ts, vc, ch, ar, fixed AS is_new, 0 AS uv, CAST(last_page_id IS NULL AS INT) AS sv, 1 AS pv, k AS dur, 0 AS uj FROM pages
  UNION ALL SELECT ts, vc, ch, ar, fixed, 1, 0, 0, 0, 0 FROM uv
  UNION ALL SELECT ts, vc, ch, ar, fixed, 0, 0, 0, 0, 1 FROM uj
)
"""


@query(f"""
WITH {LOGS}, {_CHANNEL_ROWS}
SELECT {_SPAN.format('1 hour')}, vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct,
       CAST(sum(pv) AS BIGINT) AS pv_ct, CAST(sum(dur) AS BIGINT) AS dur_sum, CAST(sum(uj) AS BIGINT) AS uj_ct
FROM (SELECT {_b('1 hour')}, * FROM m) GROUP BY b, vc, ch, ar, is_new
""")
def rollup_channel_window(t: Tables) -> DataFrame:
    return _channel_window(t)


def _channel_window(t: Tables, version: bool = False) -> DataFrame:
    pages = page_logs(t)
    return traffic.channel_window(pages, visitor_rows(pages), bounce_rows(pages), "1 hour", version=version)


@query(f"""
WITH {LOGS},
f AS (SELECT mid, page_id, CAST(ts AS DATE) AS day, min(ts) AS ts FROM pages WHERE page_id IN ('home', 'good_detail') GROUP BY 1, 2, 3)
SELECT {_SPAN.format('1 hour')}, count(*) FILTER (page_id = 'home') AS home_uv_ct, count(*) FILTER (page_id = 'good_detail') AS good_detail_uv_ct
FROM (SELECT {_b('1 hour')}, page_id FROM f) GROUP BY b
""")
def rollup_page_view_window(t: Tables) -> DataFrame:
    return traffic.page_view_window(page_logs(t), "1 hour", version=False)


@query(f"""
WITH {LOGS},
d AS (SELECT uid, CAST(ts AS DATE) AS day, min(ts) AS ts FROM pages WHERE uid IS NOT NULL AND (page_id = 'login' OR last_page_id IS NULL) GROUP BY 1, 2),
f AS (SELECT *, lag(day) OVER (PARTITION BY uid ORDER BY day) AS prev FROM d)
SELECT {_SPAN.format('1 hour')}, CAST(sum(CASE WHEN day - prev > 7 THEN 1 ELSE 0 END) AS BIGINT) AS back_ct, count(*) AS uu_ct
FROM (SELECT {_b('1 hour')}, * FROM f) GROUP BY b
""")
def rollup_login_window(t: Tables) -> DataFrame:
    return traffic.login_window(page_logs(t), "1 hour", version=False)


@query(f"""
SELECT {_SPAN.format('1 hour')}, count(*) AS register_ct FROM (SELECT {_b('1 hour')} FROM events WHERE event_type = 'signup') GROUP BY b
""")
def rollup_register_window(t: Tables) -> DataFrame:
    return tools.register_window(registers(t), "1 hour", version=False)


# --- trade ---------------------------------------------------------------------------------------


@query(f"""
WITH {CARTS},
f AS (SELECT user_id, CAST(moment AS DATE) AS day, min(moment) AS ts FROM (SELECT user_id, CAST(coalesce(operate_time, create_time) AS TIMESTAMP) AS moment FROM cart) GROUP BY 1, 2)
SELECT {_SPAN.format('1 hour')}, count(*) AS cart_add_uu_ct FROM (SELECT {_b('1 hour')} FROM f) GROUP BY b
""")
def rollup_cart_add_window(t: Tables) -> DataFrame:
    return trade.cart_add_window(carts(t), "1 hour", version=False)


@query(f"""
WITH {LINES}, {PAID},
days AS (SELECT DISTINCT user_id, CAST(callback_time AS TIMESTAMP) AS ts FROM pd),
f AS (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM days)
SELECT {_SPAN.format('1 day')}, count(*) AS payment_suc_unique_user_count, count(*) FILTER (prev IS NULL) AS payment_suc_new_user_count
FROM (SELECT {_b('1 day')}, prev FROM f) GROUP BY b
""")
def rollup_payment_window(t: Tables) -> DataFrame:
    return trade.payment_window(paid_lines(t), "1 day", version=False)


@query(f"""
WITH {LINES},
o AS (SELECT {PLACED} FROM pre WHERE type = 'insert'),
u AS (SELECT DISTINCT user_id, CAST(create_time AS TIMESTAMP) AS b FROM o),
f AS (SELECT b, lag(b) OVER (PARTITION BY user_id ORDER BY b) AS prev FROM u),
g AS (SELECT b, count(*) AS uu, count(*) FILTER (prev IS NULL) AS nn FROM f GROUP BY b),
a AS (SELECT CAST(create_time AS TIMESTAMP) AS b, round(sum(coalesce(CAST(split_activity_amount AS DOUBLE), 0)), 2) AS x,
             round(sum(coalesce(CAST(split_coupon_amount AS DOUBLE), 0)), 2) AS y, round(sum(CAST(split_original_amount AS DOUBLE)), 2) AS z FROM o GROUP BY 1)
SELECT {_SPAN.format('1 day')}, uu AS order_unique_user_count, nn AS order_new_user_count, x AS order_activity_reduce_amount,
       y AS order_coupon_reduce_amount, z AS order_origin_total_amount FROM g JOIN a USING (b)
""")
def rollup_order_window(t: Tables) -> DataFrame:
    placed = trade.order_detail(pre_processed(t))
    return _money(
        trade.order_window(placed, "1 day", version=False),
        "order_activity_reduce_amount", "order_coupon_reduce_amount", "order_origin_total_amount",
    )


def catalog(t: Tables) -> dict[str, DataFrame]:
    """The product snowflake cut out of the part table."""
    text = lambda c: F.col(c).cast("string")
    part = t.part
    sizes = part.select("p_size").distinct()
    return {
        "sku": part.select(
            text("p_partkey").alias("id"), text("p_size").alias("spu_id"), F.col("p_type").alias("category3_id"),
            F.col("p_brand").alias("tm_id"),
        ),
        "spu": sizes.select(text("p_size").alias("id"), F.concat(F.lit("spu "), "p_size").alias("spu_name")),
        "trademark": part.select("p_brand").distinct().select(
            F.col("p_brand").alias("id"), F.concat(F.lit("tm "), "p_brand").alias("tm_name")
        ),
        "category3": part.select("p_type").distinct().select(
            F.col("p_type").alias("id"), F.concat(F.lit("c3 "), "p_type").alias("name"),
            F.substring("p_type", 1, 1).alias("category2_id"),
        ),
        "category2": part.select(F.substring("p_type", 1, 1).alias("id")).distinct().select(
            "id", F.concat(F.lit("c2 "), "id").alias("name"), F.when(F.col("id") < "M", "1").otherwise("30").alias("category1_id")
        ),
        # No nation has number 30: half of the products have no name at this level.
        "category1": t.nation.select(
            text("n_nationkey").alias("id"), F.lower("n_name").alias("name")
        ),
    }


_NAMES = """trademark_id, 'tm ' || trademark_id AS trademark_name, c1 AS category1_id, (SELECT lower(n_name) FROM nation WHERE CAST(n_nationkey AS VARCHAR) = c1) AS category1_name,
c2 AS category2_id, 'c2 ' || c2 AS category2_name, category3_id, 'c3 ' || category3_id AS category3_name"""
_LEVELS = "SELECT *, left(category3_id, 1) AS c2, CASE WHEN left(category3_id, 1) < 'M' THEN '1' ELSE '30' END AS c1 FROM g"


@query(f"""
WITH {LINES},
g AS (
  SELECT CAST(create_time AS TIMESTAMP) AS b, user_id, CAST(p_size AS VARCHAR) AS spu_id, p_type AS category3_id, p_brand AS trademark_id,
         count(DISTINCT order_id) AS order_count, round(sum(CAST(split_total_amount AS DOUBLE)), 2) AS order_amount
  FROM pre JOIN part ON sku_id = CAST(p_partkey AS VARCHAR) WHERE type = 'insert' GROUP BY 1, 2, 3, 4, 5)
SELECT {_SPAN.format('1 day')}, {_NAMES}, user_id, spu_id, 'spu ' || spu_id AS spu_name, order_count, order_amount FROM ({_LEVELS})
""")
def rollup_user_spu_window(t: Tables) -> DataFrame:
    return _money(_user_spu(t), "order_amount")


def _user_spu(t: Tables, version: bool = False) -> DataFrame:
    return trade.user_spu_window(trade.order_detail(pre_processed(t)), **catalog(t), size="1 day", version=version)


def user_spu_summary(t: Tables, date: int) -> DataFrame:
    path = layer_path(t, "summary-user-spu", lambda p: store_summary(_user_spu(t, version=True), p))
    return read_summary(t.spark, path, ["user_id", "spu_id", "category3_id", "trademark_id"], date)


def channel_summary(t: Tables, date: int) -> DataFrame:
    path = layer_path(t, "summary-channel", lambda p: store_summary(_channel_window(t, version=True), p))
    return read_summary(t.spark, path, ["vc", "ch", "ar", "is_new"], date)


@query(f"""
WITH {LINES},
g AS (
  SELECT CAST(create_time AS TIMESTAMP) AS b, province_id, count(DISTINCT order_id) AS order_count, round(sum(CAST(split_total_amount AS DOUBLE)), 2) AS order_amount
  FROM pre WHERE type = 'insert' GROUP BY 1, 2)
SELECT {_SPAN.format('1 day')}, province_id, n_name AS province_name, order_count, order_amount
FROM g LEFT JOIN nation ON province_id = CAST(n_nationkey AS VARCHAR)
""")
def rollup_province_window(t: Tables) -> DataFrame:
    provinces = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    placed = trade.order_detail(pre_processed(t))
    return _money(trade.province_window(placed, provinces, "1 day", version=False), "order_amount")


@query(f"""
WITH {REFUNDS},
g AS (
  SELECT CAST(create_time AS TIMESTAMP) AS b, user_id, p_type AS category3_id, p_brand AS trademark_id, count(DISTINCT order_id) AS refund_count
  FROM rf JOIN part ON sku_id = CAST(p_partkey AS VARCHAR) GROUP BY 1, 2, 3, 4)
SELECT {_SPAN.format('1 day')}, {_NAMES}, user_id, refund_count FROM ({_LEVELS})
""")
def rollup_refund_window(t: Tables) -> DataFrame:
    levels = {k: v for k, v in catalog(t).items() if k != "spu"}
    return trade.refund_window(refunds(t), **levels, size="1 day", version=False)


# --- dashboards ----------------------------------------------------------------------------------


@query(f"""
WITH {LINES}
SELECT '{{"status":0,"msg":"","data":' || CAST(CAST(round(sum(CAST(split_total_amount AS DOUBLE)), 2) AS DECIMAL(18,2)) AS VARCHAR) || '}}' AS payload
FROM pre WHERE type = 'insert' AND date_id = '1998-10-03'
""")
def dashboard_gmv(t: Tables) -> DataFrame:
    exact = user_spu_summary(t, 19981003).withColumn("order_amount", F.col("order_amount").cast("decimal(18,2)"))
    return dashboard.gmv_answer(exact, 19981003)


@query(f"""
WITH {LOGS},
top AS (SELECT ch, count(*) AS uv FROM uv WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY ch ORDER BY uv DESC, ch LIMIT 5)
SELECT '{{"status":0,"msg":"","data":{{"categories":["' || string_agg(ch, '","' ORDER BY uv DESC, ch)
       || '"],"series":[{{"name":"日活","data":[' || string_agg(CAST(uv AS VARCHAR), ',' ORDER BY uv DESC, ch) || ']}}]}}}}' AS payload
FROM top
""")
def dashboard_channels(t: Tables) -> DataFrame:
    return dashboard.channel_answer(channel_summary(t, 20240115), 20240115)
