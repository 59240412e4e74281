"""Tumbling event-time summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.functions.times import full, version_millis

WINDOW = "10 seconds"
DELAY = "2 seconds"
# Bounce rows appear up to 10 s + 2 s behind the page rows they are summed with.
LATE_DELAY = "13 seconds"


def with_event_time(df: DataFrame, ts: Column | str, delay: str = DELAY, out: str = "rt") -> DataFrame:
    """Name the event-time column and let rows arrive up to `delay` out of order."""
    return df.withColumn(out, F.col(ts) if isinstance(ts, str) else ts).withWatermark(out, delay)


def to_metrics(
    df: DataFrame, ts: Column | str, keys: Mapping[str, Column | str], metrics: Mapping[str, Column | int], out: str = "rt"
) -> DataFrame:
    """Event rows as summable metric rows: integers become constant indicator columns."""
    return df.select(
        (F.col(ts) if isinstance(ts, str) else ts).alias(out),
        *((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in keys.items()),
        *((F.lit(m).cast("bigint") if isinstance(m, int) else m).alias(k) for k, m in metrics.items()),
    )


def _finish(df: DataFrame, columns: Sequence[Column | str], version: bool) -> DataFrame:
    tail = [version_millis().alias("ts")] if version else []
    return df.select(full("window.start").alias("stt"), full("window.end").alias("edt"), *columns, *tail)


def tumble(
    df: DataFrame,
    ts: str,
    size: str,
    aggs: Mapping[str, Column],
    keys: Sequence[str] = (),
    version: bool = True,
) -> DataFrame:
    """Window start and end as text, keys, aggregates, and the version column `ts`."""
    grouped = df.groupBy(F.window(ts, size), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return _finish(grouped, [*keys, *aggs], version)


def sums(*names: str) -> dict[str, Column]:
    return {n: F.sum(n) for n in names}


def tumble_distinct(
    df: DataFrame,
    ts: str,
    size: str,
    distinct: str,
    count_name: str,
    sum_cols: Sequence[str] = (),
    keys: Sequence[str] = (),
    version: bool = True,
    approx: bool = False,
) -> DataFrame:
    """Exact distinct count of `distinct` and sums per window and key.

    Two chained aggregates, first per distinct value, then per key: no task ever holds the set
    of values of a busy key, and the same plan runs on a stream in append mode.
    `approx` trades exactness for a single sketch aggregate.
    """
    window = F.window(ts, size)
    if approx:
        one = df.groupBy(window, *keys).agg(
            F.approx_count_distinct(distinct).alias(count_name), *(F.sum(c).alias(c) for c in sum_cols)
        )
        return _finish(one, [*keys, count_name, *sum_cols], version)
    per_value = df.groupBy(window, *keys, distinct).agg(
        F.count("*").alias("__rows"), *(F.sum(c).alias(c) for c in sum_cols)
    )
    again = F.window(F.window_time("window"), size) if df.isStreaming else F.col("window")
    per_key = per_value.groupBy(again, *keys).agg(
        F.count(distinct).alias(count_name), *(F.sum(c).alias(c) for c in sum_cols)
    )
    return _finish(per_key, [*keys, count_name, *sum_cols], version)
