"""Coupon, favourite, comment and registration facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.functions.times import date_id, parse_time
from tidemart.operators.changes import became, change_events, rename
from tidemart.operators.enrich import lookup
from tidemart.operators.windows import DELAY, WINDOW, sums, to_metrics, tumble

COUPON_UNUSED, COUPON_USED = "1401", "1402"


def _dated(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("date_id", date_id(time))


def coupon_get(changes: DataFrame, database: str | None = None) -> DataFrame:
    rows = change_events(changes, "coupon_use", ["id", "coupon_id", "user_id", "get_time"], ["insert"], database)
    return _dated(rows, "get_time").select("id", "coupon_id", "user_id", "date_id", "get_time")


def coupon_order(changes: DataFrame, database: str | None = None) -> DataFrame:
    """Coupons put on an order: unused becomes used."""
    rows = change_events(
        changes, "coupon_use", ["id", "coupon_id", "user_id", "order_id", "using_time"], ["update"], database,
        where=became("coupon_status", COUPON_USED, COUPON_UNUSED),
    )
    return _coupon_fact(_dated(rows, "using_time"), "using_time", "order_time")


def coupon_pay(changes: DataFrame, database: str | None = None) -> DataFrame:
    """Coupons whose order was paid: the update carries a time of use."""
    rows = change_events(
        changes, "coupon_use", ["id", "coupon_id", "user_id", "order_id", "used_time"], ["update"], database,
        where=F.col("data")["used_time"].isNotNull(),
    )
    return _coupon_fact(_dated(rows, "used_time"), "used_time", "payment_time")


def _coupon_fact(rows: DataFrame, time: str, name: str) -> DataFrame:
    same = ("id", "coupon_id", "user_id", "order_id", "date_id")
    return rename(rows, {**{c: c for c in same}, name: time})


def favor_add(changes: DataFrame, database: str | None = None) -> DataFrame:
    rows = change_events(changes, "favor_info", ["id", "user_id", "sku_id", "create_time"], ["insert"], database)
    return _dated(rows, "create_time").select("id", "user_id", "sku_id", "date_id", "create_time")


def comment(changes: DataFrame, dictionary: DataFrame, database: str | None = None) -> DataFrame:
    rows = change_events(
        changes, "comment_info",
        {**{c: c for c in ("id", "user_id", "sku_id", "order_id", "create_time")}, "appraise_code": "appraise"},
        ["insert"], database,
    )
    named = lookup(_dated(rows, "create_time"), dictionary, "appraise_code", "appraise_name")
    return named.select(
        "id", "user_id", "sku_id", "order_id", "date_id", "create_time", "appraise_code", "appraise_name"
    )


def user_register(changes: DataFrame, database: str | None = None) -> DataFrame:
    rows = change_events(
        changes, "user_info", {"user_id": "id", "create_time": "create_time"}, ["insert"], database
    )
    return _dated(rows, "create_time").select("user_id", "date_id", "create_time")


def register_window(registers: DataFrame, size: str = WINDOW, version: bool = True) -> DataFrame:
    rows = to_metrics(registers, parse_time("create_time"), {}, {"register_ct": 1}).withWatermark("rt", DELAY)
    return tumble(rows, "rt", size, sums("register_ct"), version=version)
