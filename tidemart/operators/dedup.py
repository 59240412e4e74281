"""First and latest row per key.

The batch forms are aggregates rather than ranked windows: each map task keeps one row per key
before the shuffle, so a key with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _order(cols: Sequence[str | Column]) -> Column:
    return F.struct(*cols)


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, F.min_by(F.struct(*df.columns), _order(order)))


def latest_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The row with the highest version; pass (version, arrival order) to settle ties.

    Where keys and order name every column, rows are their own order and travel once, not beside a copy of it.
    """
    if _orders_all(df, keys, order):
        return df.groupBy(*keys).agg(F.max(_order(order)).alias("__row")).select(*(F.col("__row")[c].alias(c) if c in order else F.col(c) for c in df.columns))
    return _pick(df, keys, F.max_by(F.struct(*df.columns), _order(order)))


def _pick(df: DataFrame, keys: Sequence[str | Column], chosen: Column) -> DataFrame:
    grouping = [(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*grouping).agg(chosen.alias("__row")).select("__row.*")


def _orders_all(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], beside: Sequence[str] = ()) -> bool:
    """Whether keys and order are names and, with `beside`, those of all columns. Grouping may respell a fractional key."""
    names = [*keys, *order]
    if not all(isinstance(n, str) for n in names) or len(set(names)) < len(names) or set(names) | set(beside) != set(df.columns):
        return False
    return not any(isinstance(df.schema[k].dataType, (T.FractionalType, T.ArrayType, T.StructType)) for k in keys)


def first_per_day(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str | Column] = ()
) -> DataFrame:
    """The first row of each key on each day of `ts`."""
    return first_per_key(df, [*keys, F.to_date(ts)], [ts, *order])


def first_within(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Streaming: the first row to arrive per key, repeats dropped while inside `delay`."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def latest_in_window(
    df: DataFrame, keys: Sequence[str], ts: str, size: str, order: Sequence[str | Column]
) -> DataFrame:
    """Streaming twin of `latest_per_key` for versions that share one window of event time.

    `ts` comes back as the window's own time, so that a second window aggregate can follow.
    """
    if _orders_all(df, keys, order, [ts]) and ts not in order:
        rows = df.groupBy(F.window(ts, size), *keys).agg(F.max(_order(order)).alias("__row"))
        return rows.select(F.window_time("window").alias(ts), *keys, *(F.col("__row")[c].alias(c) for c in df.columns if c in order))
    others = [c for c in df.columns if c != ts and c not in keys]
    newest = df.groupBy(F.window(ts, size), *keys).agg(
        F.max_by(F.struct(*others), _order(order)).alias("__row")
    )
    return newest.select(F.window_time("window").alias(ts), *keys, "__row.*")
