"""Equi, time-bounded and interval joins for tables and streams."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.operators.sets import union_all

# How long two sides of a join may lie apart, in seconds.
ORDER_HORIZON = 5.0
PAYMENT_HORIZON = 905.0


def _interval(seconds: float) -> Column:
    # A plain literal: Spark reads it off the condition to know when join state can go.
    return F.lit(timedelta(microseconds=round(seconds * 1_000_000)))


def bounded_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "inner",
    left_ts: str | None = None,
    right_ts: str | None = None,
    horizon: float | None = None,
) -> DataFrame:
    """Join on pairs of (left column, right column).

    With `horizon`, matches must lie within that many seconds of each other; a stream needs it,
    with both sides watermarked, so that its state can be dropped. A table may go without.
    Column names of the two sides must differ. Skewed keys are split by adaptive execution.
    """
    cond = None
    for a, b in on:
        eq = F.col(a) == F.col(b)
        cond = eq if cond is None else cond & eq
    if horizon is not None:
        lt, rt = F.col(left_ts), F.col(right_ts)
        cond = cond & (rt >= lt - _interval(horizon)) & (rt <= lt + _interval(horizon))
    return left.join(right, cond, how)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    lower: float,
    upper: float,
    how: str = "inner",
) -> DataFrame:
    """Match rows with right time in [left time + lower, left time + upper], both ends included.

    On tables the equality part also carries a time bucket, as wide as the interval, so that a key
    with a third of all rows is cut along time and its rows meet near neighbours only, never all
    pairs. Streams keep the plain range condition: their state holds one interval per key.
    """
    if upper < lower:
        raise ValueError("upper must not be below lower")
    if left.isStreaming or right.isStreaming:
        cond = _range(F.col(left_ts), F.col(right_ts), lower, upper)
        for a, b in on:
            cond = cond & (F.col(a) == F.col(b))
        return left.join(right, cond, how)
    if how in ("right", "right_outer"):
        back = interval_join(right, left, [(b, a) for a, b in on], right_ts, left_ts, -upper, -lower, "left")
        return back.select(*left.columns, *right.columns)
    if how in ("full", "full_outer", "outer"):
        matched = interval_join(left, right, on, left_ts, right_ts, lower, upper, "left")
        lonely = interval_join(right, left, [(b, a) for a, b in on], right_ts, left_ts, -upper, -lower, "left_anti")
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema]
        return union_all(matched, lonely.select(*nulls, *right.columns))
    if how not in ("inner", "left", "left_outer", "left_anti", "left_semi"):
        raise ValueError(f"join type {how!r}")

    # Every left row sits in the one bucket its interval starts in; a right row is offered to the
    # two buckets whose intervals can reach it, so no pair is met twice and left joins stay exact.
    width = max(round((upper - lower) * 1_000_000), 1)
    low = round(lower * 1_000_000)
    lefts = left.withColumn("__l_us", _micros(left_ts)).withColumn(
        "__l_bucket", time_bucket(F.col("__l_us") + F.lit(low), width)
    )
    rights = right.withColumn("__r_us", _micros(right_ts)).withColumn(
        "__r_bucket",
        F.explode(F.array(*(time_bucket(F.col("__r_us"), width) - i for i in (0, 1)))),
    )
    gap = F.col("__r_us") - F.col("__l_us")
    cond = (F.col("__l_bucket") == F.col("__r_bucket")) & gap.between(low, low + width if upper > lower else low)
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return lefts.join(rights, cond, how).drop("__l_us", "__l_bucket", "__r_us", "__r_bucket")


def time_bucket(micros: Column, width: int) -> Column:
    """Number of the bucket of `width` microseconds, in exact integer arithmetic."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _range(lt: Column, rt: Column, lower: float, upper: float) -> Column:
    return (rt >= lt + _interval(lower)) & (rt <= lt + _interval(upper))
