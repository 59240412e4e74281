"""Raw feeds replayed from stored tables: log text and change-event text.

They let every job run from its raw input on data that sits in star-schema tables. One scan of a
table yields all its record kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.functions.times import FULL

DATABASE = "shop"
# Codes run past the 25 nations that serve as dictionary and province table, so that some stay unknown.
CODES = 30
PROVINCES = 27


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _money(col: str) -> Column:
    return F.col(col).cast("decimal(16,2)").cast("string")


def _when(ts: Column | str) -> Column:
    return F.date_format(ts, FULL)


def log_text(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events as application log records in the column `value`."""
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    is_kind = lambda *names: kind.isin(list(names))
    common = F.struct(
        F.concat(F.lit("ar"), user % 7).alias("ar"),
        F.concat(F.lit("ch"), user % 5).alias("ch"),
        F.when(is_kind("signup"), "1").otherwise("0").alias("is_new"),
        F.concat(F.lit("mid_"), user).alias("mid"),
        F.when(user % 3 != 0, _text(user)).alias("uid"),
        F.concat(F.lit("v"), user % 3).alias("vc"),
    )
    page = F.struct(
        k.alias("during_time"),
        F.when(is_kind("click"), F.concat(F.lit("Word"), k % 10, F.lit(" item"), k % 3)).otherwise(_text(k)).alias("item"),
        F.when(is_kind("click"), "keyword").otherwise("sku_id").alias("item_type"),
        F.when(is_kind("click"), "search")
        .when(is_kind("purchase", "error") | (is_kind("signup") & (k >= 50)), "home")
        .alias("last_page_id"),
        F.when(is_kind("view"), "home").when(is_kind("click"), "good_detail").when(is_kind("purchase"), "trade")
        .when(is_kind("signup"), "login").otherwise("mine").alias("page_id"),
    )
    display = lambda n: F.struct(
        F.lit("query").alias("display_type"), _text(k).alias("item"), F.lit("sku_id").alias("item_type"),
        F.lit(n).alias("order"), F.lit(n + 1).alias("pos_id"),
    )
    action = F.struct(
        F.lit("cart_add").alias("action_id"), _text(k).alias("item"), F.lit("sku_id").alias("item_type"),
        (ms + 1).alias("ts"),
    )
    record = F.struct(
        common.alias("common"),
        page.alias("page"),
        F.when(is_kind("view"), F.array(display(1), display(2))).alias("displays"),
        F.when(is_kind("purchase"), F.array(action)).alias("actions"),
        F.when(is_kind("error") & (k < 30), F.struct(F.lit("icon").alias("entry"))).alias("start"),
        F.when(is_kind("error"), F.struct(k.alias("error_code"))).alias("err"),
        ms.alias("ts"),
    )
    return _texts(events, [F.to_json(record)], keep)


def _change(table: str, kind: str, ts: Column, data: dict[str, Column], old: dict[str, Column] | None = None) -> Column:
    fields = [
        F.lit(DATABASE).alias("database"), F.lit(table).alias("table"), F.lit(kind).alias("type"),
        F.unix_timestamp(ts).alias("ts"),
        F.struct(*(c.alias(n) for n, c in data.items())).alias("data"),
    ]
    if old:
        fields.append(F.struct(*(c.alias(n) for n, c in old.items())).alias("old"))
    return F.to_json(F.struct(*fields))


def _feed(df: DataFrame, kinds: Sequence[str], makers: dict[str, Callable[[], Column]], keep: Sequence[str]) -> DataFrame:
    return _texts(df, [makers[k]() for k in kinds], keep).filter(F.col("value").isNotNull())


def _texts(df: DataFrame, texts: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Build texts, on all cores where a small table comes as fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not df.isStreaming and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df.select(F.explode(F.array(*texts)).alias("value"), *keep)


def order_text(orders: DataFrame, kinds: Sequence[str], keep: Sequence[str] = (), after: str = "1 day") -> DataFrame:
    """Change events of orders: placed, status (F cancelled, P refunding, O refunded), payment, coupon_get,
    coupon_order, coupon_pay; `after` is the time from placing to what follows."""
    status = F.col("o_orderstatus")
    placed = F.col("o_orderdate").cast("timestamp")
    later = placed + F.expr(f"interval {after}")
    key, user = _text("o_orderkey"), _text("o_custkey")
    province = _text(F.col("o_custkey") % PROVINCES)
    coupon = {"id": key, "coupon_id": _text(F.col("o_orderkey") % 10), "user_id": user}
    makers = {
        "placed": lambda: _change(
            "order_info", "insert", placed,
            {"id": key, "user_id": user, "province_id": province, "order_status": F.lit("1001")},
        ),
        "status": lambda: _change(
            "order_info", "update", later,
            {
                "id": key, "user_id": user, "province_id": province, "operate_time": _when(later),
                "order_status": F.when(status == "F", "1003").when(status == "P", "1005").otherwise("1006"),
            },
            {"order_status": F.lit("1001")},
        ),
        "payment": lambda: _change(
            "payment_info", "update", placed,
            {
                "user_id": user, "order_id": key, "payment_type": _text(F.col("o_orderkey") % CODES),
                "callback_time": _when(later), "payment_status": F.when(status == "O", "1602").otherwise("1601"),
            },
        ),
        "coupon_get": lambda: _change("coupon_use", "insert", placed, {**coupon, "get_time": _when(placed)}),
        "coupon_order": lambda: _change(
            "coupon_use", "update", later,
            {**coupon, "order_id": key, "using_time": _when(later), "coupon_status": F.lit("1402")},
            {"coupon_status": F.when(status == "F", "1401").otherwise("1400")},
        ),
        "coupon_pay": lambda: F.when(
            status == "O",
            _change("coupon_use", "update", later, {**coupon, "order_id": key, "used_time": _when(later)},
                    {"used_time": F.lit("")}),
        ),
    }
    return _feed(orders, kinds, makers, keep)


def line_text(lines: DataFrame, kinds: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Change events of order lines: line, activity, coupon, refund, payout."""
    at = F.col("l_shipdate").cast("timestamp")
    line_id = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
    )
    order, sku = _text("l_orderkey"), _text("l_partkey")
    code = _text(F.col("l_suppkey") % CODES)
    num = _text(F.col("l_quantity").cast("int"))
    returned = F.col("l_returnflag") == "R"
    in_activity, has_coupon = F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04
    makers = {
        "line": lambda: _change(
            "order_detail", "insert", at,
            {
                "id": line_id, "order_id": order, "sku_id": sku, "sku_name": F.concat(F.lit("sku "), sku),
                "create_time": _when(at), "source_id": _text("l_suppkey"), "source_type": code, "sku_num": num,
                "order_price": _money("l_extendedprice"), "split_total_amount": _money("l_extendedprice"),
                "split_activity_amount": F.when(in_activity, _money("l_discount")),
                "split_coupon_amount": F.when(has_coupon, _money("l_tax")),
            },
        ),
        "activity": lambda: F.when(
            in_activity,
            _change("order_detail_activity", "insert", at,
                    {"order_detail_id": line_id, "activity_id": _text("l_linenumber"), "activity_rule_id": num}),
        ),
        "coupon": lambda: F.when(
            has_coupon,
            _change("order_detail_coupon", "insert", at,
                    {"order_detail_id": line_id, "coupon_id": _text(F.col("l_orderkey") % 10)}),
        ),
        "refund": lambda: F.when(
            returned,
            _change(
                "order_refund_info", "insert", at,
                {
                    "id": line_id, "user_id": _text("l_suppkey"), "order_id": order, "sku_id": sku,
                    "refund_type": code, "refund_reason_type": _text(F.col("l_partkey") % CODES),
                    "refund_reason_txt": F.concat(F.lit("reason "), F.col("l_partkey") % CODES),
                    "refund_num": num, "refund_amount": _money("l_extendedprice"), "create_time": _when(at),
                },
            ),
        ),
        "payout": lambda: F.when(
            returned & (F.col("l_linestatus") == "F"),
            _change(
                "refund_payment", "insert", at,
                {
                    "id": line_id, "order_id": order, "sku_id": sku, "payment_type": code,
                    "callback_time": _when(at + F.expr("interval 1 day")), "total_amount": _money("l_extendedprice"),
                },
            ),
        ),
    }
    return _feed(lines, kinds, makers, keep)


def event_text(events: DataFrame, kinds: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Change events of user actions: cart, favor, comment, user."""
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = {"id": _text("event_id"), "user_id": _text("user_id"), "sku_id": _text(k), "create_time": _when(at)}
    cart = {
        **base, "sku_num": _text(k), "sku_name": F.concat(F.lit("sku "), k), "is_checked": F.lit("1"),
        "source_type": _text(k % CODES), "source_id": _text("user_id"), "is_ordered": F.lit("0"),
    }
    hour_later = at + F.expr("interval 1 hour")
    makers = {
        "cart": lambda: F.when(kind == "click", _change("cart_info", "insert", at, cart))
        .when(
            kind == "purchase",
            _change("cart_info", "update", hour_later, {**cart, "operate_time": _when(hour_later)},
                    {"sku_num": _text(F.floor("value"))}),
        )
        .when(
            kind == "view",
            _change("cart_info", "update", hour_later, {**cart, "operate_time": _when(hour_later)},
                    {"is_checked": F.lit("0")}),
        ),
        "favor": lambda: F.when(kind == "view", _change("favor_info", "insert", at, base)),
        "comment": lambda: F.when(
            kind == "click",
            _change("comment_info", "insert", at,
                    {**base, "order_id": _text("event_id"), "appraise": _text(k % CODES)}),
        ),
        "user": lambda: F.when(
            kind == "signup", _change("user_info", "insert", at, {"id": _text("event_id"), "create_time": _when(at)})
        ),
    }
    return _feed(events, kinds, makers, keep)


def table_text(df: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """Every row of a small master table as a bootstrap change event; `columns` maps field -> column."""
    record = F.struct(
        F.lit(DATABASE).alias("database"), F.lit(table).alias("table"),
        F.lit("bootstrap-insert").alias("type"), F.lit(0).cast("bigint").alias("ts"),
        F.struct(*(_text(c).alias(n) for n, c in columns.items())).alias("data"),
    )
    return _texts(df, [F.to_json(record)], ())


def dictionary_of(df: DataFrame, code: str, name: str) -> DataFrame:
    return df.select(_text(code).alias("dic_code"), F.col(name).alias("dic_name"))
