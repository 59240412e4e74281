"""Trade jobs: order, payment, refund and cart facts, and their window summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.functions.times import date_id, parse_time
from tidemart.functions.values import amount, product_text
from tidemart.operators.changes import became, change_events, changed, positive_delta, rename
from tidemart.operators.dedup import latest_in_window, latest_per_key
from tidemart.operators.enrich import add_catalog_keys, add_catalog_names, enrich, lookup
from tidemart.operators.joins import ORDER_HORIZON, PAYMENT_HORIZON, bounded_join
from tidemart.operators.sets import union_all
from tidemart.operators.visitors import daily_visits, is_first_ever
from tidemart.operators.windows import DELAY, WINDOW, sums, to_metrics, tumble, tumble_distinct
from tidemart.streaming.ordered import daily_visits_stream

CANCELLED, REFUNDING, REFUNDED = "1003", "1005", "1006"
PAID = "1602"

_AMOUNTS = (
    "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount",
)


def _timed(df: DataFrame, name: str) -> DataFrame:
    """Event seconds of a change event as a watermarked column called `name`."""
    return df.withColumn(name, F.timestamp_seconds("ts")).drop("ts").withWatermark(name, DELAY)


def _horizon(df: DataFrame, default: float, horizon: float | None) -> float | None:
    """Streams bound their joins in time; tables join without a bound unless one is asked for."""
    return default if horizon is None and df.isStreaming else horizon


def cart_add(changes: DataFrame, dictionary: DataFrame, database: str | None = None) -> DataFrame:
    columns = [
        "id", "user_id", "sku_id", "sku_name", "is_checked", "create_time", "operate_time",
        "is_ordered", "order_time", "source_type", "source_id",
    ]
    # Output order, with the added number and the name of the source in their places.
    out = {
        "id": "id", "user_id": "user_id", "sku_id": "sku_id", "sku_num": "added_num", "sku_name": "sku_name",
        "is_checked": "is_checked", "create_time": "create_time", "operate_time": "operate_time", "is_ordered": "is_ordered",
        "order_time": "order_time", "source_type": "source_type", "dic_name": "dic_name", "source_id": "source_id",
    }
    cond = F.col("table") == "cart_info"
    if database is not None:
        cond = cond & (F.col("database") == database)
    grown = positive_delta(changes.filter(cond), "sku_num", out="added_num")
    rows = change_events(grown, "cart_info", columns, keep=["added_num"])
    named = lookup(rows, dictionary, "source_type", "dic_name")
    return rename(named, out)


def order_pre_process(
    changes: DataFrame, dictionary: DataFrame, database: str | None = None, horizon: float | None = None,
    offset: str | None = None,
) -> DataFrame:
    """Order lines joined with their order's events, activity and coupon, one row per line and event.

    `offset` names a column with the place of a change in its topic; a joined row takes the latest of its parts, which
    settles versions of equal time in the summaries.
    """
    h = _horizon(changes, ORDER_HORIZON, horizon)
    placed = [offset] if offset else []

    def own(df: DataFrame, side: str) -> DataFrame:
        return df.withColumnRenamed(offset, f"__{side}_offset") if offset else df

    orders = _timed(
        change_events(
            changes, "order_info",
            {"info_id": "id", **{c: c for c in ("user_id", "province_id", "operate_time", "order_status")}},
            ["insert", "update"], database, keep=["type", "old", "ts", *placed],
        ),
        "info_ts",
    )
    lines = change_events(
        changes, "order_detail",
        ["id", "order_id", "sku_id", "sku_name", "create_time", "source_id", "source_type", "sku_num",
         "order_price", "split_total_amount", "split_activity_amount", "split_coupon_amount"],
        ["insert"], database, keep=["ts", *placed],
    )
    lines = _timed(lines.withColumn("split_original_amount", product_text("sku_num", "order_price")), "line_ts")
    coupons = _timed(
        change_events(changes, "order_detail_coupon", {"coupon_line": "order_detail_id", "coupon_id": "coupon_id"},
                      ["insert"], database, keep=["ts", *placed]),
        "coupon_ts",
    )
    activities = _timed(
        change_events(
            changes, "order_detail_activity",
            {"activity_line": "order_detail_id", "activity_id": "activity_id", "activity_rule_id": "activity_rule_id"},
            ["insert"], database, keep=["ts", *placed],
        ),
        "activity_ts",
    )
    orders, lines, coupons, activities = own(orders, "info"), own(lines, "line"), own(coupons, "coupon"), own(activities, "activity")
    latest = [F.greatest(*(f"__{side}_offset" for side in ("info", "line", "coupon", "activity"))).alias(offset)] if offset else []
    # The dictionary join drops lines first. Activity and coupon share the line id and so one shuffle
    # of the lines; the order join, which repeats a line for every event of its order, comes last.
    joined = lookup(lines, dictionary, "source_type", "source_type_name")
    joined = bounded_join(joined, activities, [("id", "activity_line")], "left", "line_ts", "activity_ts", h)
    joined = bounded_join(joined, coupons, [("id", "coupon_line")], "left", "line_ts", "coupon_ts", h)
    joined = bounded_join(joined, orders, [("order_id", "info_id")], "inner", "line_ts", "info_ts", h)
    return joined.select(
        "id", "order_id", "user_id", "order_status", "sku_id", "sku_name", "province_id",
        "activity_id", "activity_rule_id", "coupon_id", date_id("create_time").alias("date_id"),
        "create_time", date_id("operate_time").alias("operate_date_id"), "operate_time",
        "source_id", "source_type", "source_type_name", "sku_num",
        "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount",
        "type", "old", F.current_timestamp().alias("row_op_ts"), *latest,
    )


def _line_fact(rows: DataFrame, day: str, time: str, time_name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    same = ("id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id",
            "activity_rule_id", "coupon_id")
    return rename(
        rows,
        {
            **{c: c for c in same}, "date_id": day, time_name: time, "source_id": "source_id",
            "source_type_code": "source_type",
            **{c: c for c in ("source_type_name", "sku_num", *_AMOUNTS, "row_op_ts", *keep)},
        },
    )


def order_detail(pre: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Placed order lines; `keep` names arrival columns of the pre-processed rows."""
    return _line_fact(pre.filter(F.col("type") == "insert"), "date_id", "create_time", "create_time", keep)


def cancel_detail(pre: DataFrame) -> DataFrame:
    """Order lines whose order turned cancelled."""
    hit = (F.col("type") == "update") & changed("order_status") & (F.col("order_status") == CANCELLED)
    return _line_fact(pre.filter(hit), "operate_date_id", "operate_time", "cancel_time")


def payment_detail(
    changes: DataFrame, details: DataFrame, dictionary: DataFrame, database: str | None = None,
    horizon: float | None = None,
) -> DataFrame:
    """Paid order lines. A stream matches a payment with lines placed up to `horizon` seconds around it."""
    h = _horizon(changes, PAYMENT_HORIZON, horizon)
    paid = change_events(
        changes, "payment_info",
        {"pay_order": "order_id", "payment_type_code": "payment_type", "callback_time": "callback_time"},
        ["update"], database, where=became("payment_status", PAID), keep=["ts"],
    )
    paid = lookup(_timed(paid, "paid_ts"), dictionary, "payment_type_code", "payment_type_name")
    lines = details.withColumn("placed_ts", parse_time("create_time")).withWatermark("placed_ts", DELAY)
    joined = bounded_join(lines, paid, [("order_id", "pay_order")], "inner", "placed_ts", "paid_ts", h)
    return rename(
        joined,
        {
            "order_detail_id": "id",
            **{c: c for c in (
                "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id",
                "activity_rule_id", "coupon_id", "payment_type_code", "payment_type_name",
                "callback_time", "source_id", "source_type_code", "source_type_name", "sku_num",
                "split_original_amount", "split_activity_amount", "split_coupon_amount",
            )},
            "split_payment_amount": "split_total_amount", "row_op_ts": "row_op_ts",
        },
    )


def _order_turned(changes: DataFrame, status: str, columns: dict[str, str], database: str | None) -> DataFrame:
    return _timed(
        change_events(
            changes, "order_info", columns, ["update"], database,
            where=became("order_status", status) & changed("order_status"), keep=["ts"],
        ),
        "info_ts",
    )


def order_refund(
    changes: DataFrame, dictionary: DataFrame, database: str | None = None, horizon: float | None = None
) -> DataFrame:
    """Refund requests of orders that turned refunding, type and reason spelled out."""
    h = _horizon(changes, ORDER_HORIZON, horizon)
    asked = _timed(
        change_events(
            changes, "order_refund_info",
            {
                **{c: c for c in ("id", "user_id", "order_id", "sku_id", "create_time")},
                "refund_type_code": "refund_type", "refund_reason_type_code": "refund_reason_type",
                **{c: c for c in ("refund_reason_txt", "refund_num", "refund_amount")},
            },
            ["insert"], database, keep=["ts"],
        ),
        "asked_ts",
    )
    asked = lookup(asked, dictionary, "refund_type_code", "refund_type_name")
    asked = lookup(asked, dictionary, "refund_reason_type_code", "refund_reason_type_name")
    orders = _order_turned(changes, REFUNDING, {"info_id": "id", "province_id": "province_id"}, database)
    joined = bounded_join(asked, orders, [("order_id", "info_id")], "inner", "asked_ts", "info_ts", h)
    return joined.select(
        "id", "user_id", "order_id", "sku_id", "province_id", date_id("create_time").alias("date_id"),
        "create_time", "refund_type_code", "refund_type_name", "refund_reason_type_code",
        "refund_reason_type_name", "refund_reason_txt", "refund_num", "refund_amount",
        F.current_timestamp().alias("row_op_ts"),
    )


def refund_payment(
    changes: DataFrame, dictionary: DataFrame, database: str | None = None, horizon: float | None = None,
    payment_where=None, request_where=None,
) -> DataFrame:
    """Refunds paid out: payout, the order that turned refunded, and the request for the same line."""
    h = _horizon(changes, ORDER_HORIZON, horizon)
    payout = _timed(
        change_events(
            changes, "refund_payment",
            {
                **{c: c for c in ("id", "order_id", "sku_id")}, "payment_type_code": "payment_type",
                "callback_time": "callback_time", "refund_amount": "total_amount",
            },
            None, database, where=payment_where, keep=["ts"],
        ),
        "payout_ts",
    )
    payout = lookup(payout, dictionary, "payment_type_code", "payment_type_name")
    orders = _order_turned(
        changes, REFUNDED, {"info_id": "id", "user_id": "user_id", "province_id": "province_id"}, database
    )
    asked = _timed(
        change_events(
            changes, "order_refund_info",
            {"asked_order": "order_id", "asked_sku": "sku_id", "refund_num": "refund_num"},
            None, database, where=request_where, keep=["ts"],
        ),
        "asked_ts",
    )
    joined = bounded_join(payout, orders, [("order_id", "info_id")], "inner", "payout_ts", "info_ts", h)
    joined = bounded_join(
        joined, asked, [("order_id", "asked_order"), ("sku_id", "asked_sku")], "inner", "payout_ts", "asked_ts", h
    )
    return joined.select(
        "id", "user_id", "order_id", "sku_id", "province_id", "payment_type_code", "payment_type_name",
        date_id("callback_time").alias("date_id"), "callback_time", "refund_num", "refund_amount",
        F.current_timestamp().alias("row_op_ts"),
    )


def _visits(df: DataFrame, key: str) -> DataFrame:
    run = daily_visits_stream if df.isStreaming else daily_visits
    return run(df, key, "rt").select(key, "rt", "day", "previous_day")


def cart_add_window(carts: DataFrame, size: str = WINDOW, version: bool = True) -> DataFrame:
    """Users adding to a cart for the first time that day; an update counts when it was made."""
    timed = carts.select(
        "user_id", parse_time(F.coalesce("operate_time", "create_time")).alias("rt")
    ).withWatermark("rt", DELAY)
    rows = to_metrics(_visits(timed, "user_id"), "rt", {}, {"cart_add_uu_ct": 1})
    return tumble(rows, "rt", size, sums("cart_add_uu_ct"), version=version)


def payment_window(payments: DataFrame, size: str = WINDOW, version: bool = True) -> DataFrame:
    """Paying users of the day and first-time payers.

    Repeats of an order line change neither, so they need no removal first.
    """
    timed = payments.select("user_id", parse_time("callback_time").alias("rt")).withWatermark("rt", DELAY)
    rows = to_metrics(
        _visits(timed, "user_id"), "rt", {},
        {"payment_suc_unique_user_count": 1, "payment_suc_new_user_count": is_first_ever()},
    )
    return tumble(
        rows, "rt", size, sums("payment_suc_unique_user_count", "payment_suc_new_user_count"), version=version
    )


def latest_lines(details: DataFrame, columns: list[str], order: tuple[str, ...] = (), size: str = WINDOW) -> DataFrame:
    """The newest version of each order line, `columns` and its event time `rt`.

    `order` names arrival columns. Versions that agree in time and arrival are settled by their values, so the
    result never depends on the partitioning.
    """
    timed = details.withColumn("rt", parse_time("create_time")).withWatermark("rt", DELAY)
    slim = timed.select("id", *columns, "rt", "row_op_ts", *order)
    newest = ["row_op_ts", *order, *columns]
    if slim.isStreaming:
        return latest_in_window(slim, ["id"], "rt", size, newest).select(*columns, "rt")
    return latest_per_key(slim, ["id"], [*newest, "rt"]).select(*columns, "rt")


def order_window(details: DataFrame, size: str = WINDOW, version: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """Ordering users of the day, first-time buyers, and order amounts.

    Versions of a line differ in amounts only: buyers are read off all of them, in parallel.
    """
    lines = latest_lines(
        details, ["split_activity_amount", "split_coupon_amount", "split_original_amount"], order, size
    )
    buys = details.select("user_id", parse_time("create_time").alias("rt")).withWatermark("rt", DELAY)
    users = {"order_unique_user_count": 0, "order_new_user_count": 0}
    zero = F.lit(0.0)
    money = {"order_activity_reduce_amount": zero, "order_coupon_reduce_amount": zero, "order_origin_total_amount": zero}
    amounts = to_metrics(
        lines, "rt", {},
        {
            **users,
            "order_activity_reduce_amount": amount("split_activity_amount"),
            "order_coupon_reduce_amount": amount("split_coupon_amount"),
            "order_origin_total_amount": amount("split_original_amount"),
        },
    )
    buyers = to_metrics(
        _visits(buys, "user_id"), "rt", {},
        {"order_unique_user_count": 1, "order_new_user_count": is_first_ever(), **money},
    )
    return tumble(union_all(amounts, buyers), "rt", size, sums(*users, *money), version=version)


def user_spu_window(
    details: DataFrame, sku: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame,
    category2: DataFrame, category1: DataFrame, size: str = WINDOW, version: bool = True, order: tuple[str, ...] = (),
) -> DataFrame:
    """Orders and amount per user and product. Only keys join before the aggregate, names after it."""
    lines = latest_lines(details, ["user_id", "sku_id", "order_id", "split_total_amount"], order, size)
    keyed = add_catalog_keys(lines.withColumn("order_amount", amount("split_total_amount")), sku)
    summed = tumble_distinct(
        keyed, "rt", size, "order_id", "order_count", ["order_amount"],
        ["user_id", "spu_id", "category3_id", "trademark_id"], version,
    )
    named = add_catalog_names(summed, spu, trademark, category3, category2, category1)
    return named.select(
        "stt", "edt", "trademark_id", "trademark_name", "category1_id", "category1_name",
        "category2_id", "category2_name", "category3_id", "category3_name", "user_id", "spu_id",
        "spu_name", "order_count", "order_amount", *(["ts"] if version else []),
    )


def province_window(
    details: DataFrame, province: DataFrame, size: str = WINDOW, version: bool = True, order: tuple[str, ...] = ()
) -> DataFrame:
    """Orders and amount per province; an unknown province keeps its row without a name."""
    lines = latest_lines(details, ["province_id", "order_id", "split_total_amount"], order, size)
    summed = tumble_distinct(
        lines.withColumn("order_amount", amount("split_total_amount")), "rt", size, "order_id", "order_count",
        ["order_amount"], ["province_id"], version,
    )
    named = enrich(summed, province, "province_id", {"name": "province_name"})
    return named.select(
        "stt", "edt", "province_id", "province_name", "order_count", "order_amount", *(["ts"] if version else [])
    )


def refund_window(
    refunds: DataFrame, sku: DataFrame, trademark: DataFrame, category3: DataFrame, category2: DataFrame,
    category1: DataFrame, size: str = WINDOW, version: bool = True,
) -> DataFrame:
    """Refunded orders per user, trademark and category."""
    timed = refunds.select("user_id", "sku_id", "order_id", parse_time("create_time").alias("rt")).withWatermark(
        "rt", DELAY
    )
    summed = tumble_distinct(
        add_catalog_keys(timed, sku), "rt", size, "order_id", "refund_count", (),
        ["user_id", "category3_id", "trademark_id"], version,
    )
    named = add_catalog_names(summed, None, trademark, category3, category2, category1)
    return named.select(
        "stt", "edt", "trademark_id", "trademark_name", "category1_id", "category1_name",
        "category2_id", "category2_name", "category3_id", "category3_name", "user_id", "refund_count",
        *(["ts"] if version else []),
    )
