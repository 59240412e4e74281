"""Traffic jobs: raw logs to page, visitor and bounce details, and their window summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.functions.times import from_millis, from_millis_floor
from tidemart.operators import keywords, logs
from tidemart.operators.bounce import bounces
from tidemart.operators.dedup import first_per_day
from tidemart.operators.sets import union_all
from tidemart.operators.visitors import daily_visits, is_returning
from tidemart.operators.windows import DELAY, LATE_DELAY, WINDOW, sums, to_metrics, tumble
from tidemart.sources.text import parse_logs
from tidemart.streaming.ordered import (
    bounces_stream,
    daily_visits_stream,
    first_per_day_stream,
    repair_is_new_stream,
)


def split_raw_logs(raw: DataFrame, value_col: str = "value", order: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Raw log text to five record kinds, visitor flags repaired."""
    parsed = parse_logs(raw, value_col, keep=order)
    return logs.split_log(repair_logs(parsed, order))


def fan_out_raw_logs(raw: DataFrame, value_col: str = "value", order: tuple[str, ...] = ()) -> DataFrame:
    """As `split_raw_logs`, all kinds in one frame of (`record`, JSON `value`) from one pass."""
    return logs.fan_out(repair_logs(parse_logs(raw, value_col, keep=order), order))


def repair_logs(parsed: DataFrame, order: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """Logs with repaired visitor flags; a stream may start from devices `known` before (`mid`, `first_day`)."""
    if not parsed.isStreaming:
        return logs.repair_visitors(parsed, order)
    flat = parsed.withColumns({"rt": from_millis("ts"), "__mid": F.col("common.mid"), "__flag": F.col("common.is_new")})
    before = None if known is None else known.select(F.col("mid").alias("__mid"), "first_day")
    # Records without a device have no history to be held against: they pass by the state.
    return logs.with_flag(repair_is_new_stream(flat, "__mid", "rt", "__flag", order, before), "__flag").select(*parsed.columns)


def _timed(pages: DataFrame, delay: str) -> DataFrame:
    return pages.withColumn("rt", from_millis("ts")).withWatermark("rt", delay)


def unique_visitors(pages: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """The first session entry of each device on each day; on a stream, the first to arrive."""
    timed = _timed(logs.entry_pages(pages), DELAY).withColumn("__mid", F.col("common.mid"))
    if timed.isStreaming:
        first = first_per_day_stream(timed, "__mid", "rt")
    else:
        first = first_per_day(timed, ["__mid"], "rt", order)
    return first.select(*pages.columns)


def bounce_detail(pages: DataFrame, within_seconds: int = 10, order: tuple[str, ...] = ()) -> DataFrame:
    """Session entries that lead nowhere for `within_seconds`."""
    timed = _timed(pages, DELAY).withColumn("__mid", F.col("common.mid"))
    run = bounces_stream if timed.isStreaming else bounces
    return run(timed, "__mid", "rt", logs.entered(), within_seconds, order=order).select(*pages.columns)


def keyword_window(
    pages: DataFrame, size: str = WINDOW, version: bool = True, dictionary: DataFrame | None = None
) -> DataFrame:
    """Searched words per window, cut by a dictionary where one is given."""
    found = logs.search_keywords(pages).select(
        F.col("page.item").alias("text"), from_millis_floor("ts").alias("rt")
    ).withWatermark("rt", DELAY)
    return keywords.keyword_counts(found, "text", "rt", size, version=version, dictionary=dictionary)


_CHANNEL = {"vc": "common.vc", "ch": "common.ch", "ar": "common.ar", "is_new": "common.is_new"}


def _channel_row(df: DataFrame, **metrics: Column | int) -> DataFrame:
    zero = {"uv_ct": 0, "sv_ct": 0, "pv_ct": 0, "dur_sum": 0, "uj_ct": 0}
    return to_metrics(df, from_millis("ts"), _CHANNEL, {**zero, **metrics})


def channel_window(
    pages: DataFrame, unique: DataFrame, bounced: DataFrame, size: str = WINDOW, version: bool = True
) -> DataFrame:
    """Visitors, sessions, views, dwell time and bounces by version, channel, area and newness.

    Each input has a watermark of its own, and the slowest of the three holds the windows open: visitors and bounces
    may lag behind the pages by any time. Within one input a row may be late by the delay bounces need.
    """
    parts = (
        _channel_row(
            pages,
            sv_ct=logs.entered().cast("bigint"),
            pv_ct=1,
            dur_sum=F.coalesce("page.during_time", F.lit(0)),
        ),
        _channel_row(unique, uv_ct=1),
        _channel_row(bounced, uj_ct=1),
    )
    rows = union_all(*(p.withWatermark("rt", LATE_DELAY) for p in parts))
    return tumble(
        rows, "rt", size, sums("uv_ct", "sv_ct", "pv_ct", "dur_sum", "uj_ct"), list(_CHANNEL), version
    )


def page_view_window(pages: DataFrame, size: str = WINDOW, version: bool = True) -> DataFrame:
    """Daily-unique devices on the home page and on product pages."""
    timed = _timed(logs.pages_in(pages), DELAY).select(
        F.struct("common.mid", "page.page_id").alias("visitor"), "rt"
    )
    firsts = _visits(timed, "visitor")
    rows = to_metrics(
        firsts, "rt", {},
        {
            "home_uv_ct": (F.col("visitor.page_id") == "home").cast("bigint"),
            "good_detail_uv_ct": (F.col("visitor.page_id") == "good_detail").cast("bigint"),
        },
    )
    return tumble(rows, "rt", size, sums("home_uv_ct", "good_detail_uv_ct"), version=version)


def login_window(pages: DataFrame, size: str = WINDOW, version: bool = True) -> DataFrame:
    """Users active for the first time that day, and of these the ones back after more than a week."""
    timed = _timed(logs.logins(pages), DELAY).select(F.col("common.uid").alias("uid"), "rt")
    rows = to_metrics(_visits(timed, "uid"), "rt", {}, {"back_ct": is_returning(), "uu_ct": 1})
    return tumble(rows, "rt", size, sums("back_ct", "uu_ct"), version=version)


def _visits(df: DataFrame, key: str) -> DataFrame:
    run = daily_visits_stream if df.isStreaming else daily_visits
    return run(df, key, "rt").select(key, "rt", "day", "previous_day")
