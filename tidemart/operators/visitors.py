"""Visit history per user or device: new-visitor repair, first-time, daily and returning flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemart.operators.hotkeys import HOT_ROWS, attach_per_key

RETURN_GAP_DAYS = 7


def repair_is_new(
    df: DataFrame,
    key: str,
    ts: str,
    flag: str,
    order: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Set `flag` to '0' where a device claims to be new on a day that is not its first.

    The first record of a device fixes its first day: its own day if it says '1', otherwise the
    day before. Later records that say '1' on another day are corrected.
    """
    first_flag = F.min_by(flag, F.struct(ts, *order))
    first_day = F.to_date(F.min(ts))
    state = df.groupBy(key).agg(
        F.when(first_flag == "1", first_day).otherwise(F.date_sub(first_day, 1)).alias("__first_day"),
        F.count("*").alias("__rows"),
    )
    wrong = (F.col(flag) == "1") & (F.to_date(ts) != F.col("__first_day"))
    return attach_per_key(df, state, [key], "__rows", hot_rows).withColumn(
        flag, F.when(wrong, "0").otherwise(F.col(flag))
    ).drop("__first_day")


def daily_visits(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key and day: `day`, first `ts` that day, and `previous_day` with a visit.

    Rows collapse to key-days before the window runs, so its partitions hold days, not rows.
    """
    days = df.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.min(ts).alias(ts), F.count("*").alias("visits")
    )
    return days.withColumn("previous_day", F.lag("day").over(Window.partitionBy(key).orderBy("day")))


def is_first_ever(previous_day: str = "previous_day") -> Column:
    return F.col(previous_day).isNull().cast("bigint")


def is_returning(gap_days: int = RETURN_GAP_DAYS, day: str = "day", previous_day: str = "previous_day") -> Column:
    """1 when the last visit lies strictly more than `gap_days` days back."""
    return F.coalesce(F.datediff(day, previous_day) > gap_days, F.lit(False)).cast("bigint")


def first_flags(
    df: DataFrame,
    key: str,
    ts: str,
    order: Sequence[str],
    unique: str = "is_unique",
    new: str = "is_new_user",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row with two flags: first of its user that day, and first of its user ever.

    `order` must make rows of one user distinct together with `ts`.
    """
    rank = F.struct(ts, *order)
    days = df.groupBy(key, F.to_date(ts).alias("__day")).agg(
        F.min(rank).alias("__first"), F.count("*").alias("__rows")
    )
    state = days.withColumn(
        "__first_day", F.min("__day").over(Window.partitionBy(key))
    )
    rows = df.withColumn("__day", F.to_date(ts))
    joined = attach_per_key(rows, state, [key, "__day"], "__rows", hot_rows)
    first_today = F.coalesce(F.col("__first") == rank, F.lit(False))
    return joined.select(
        *df.columns,
        first_today.cast("bigint").alias(unique),
        (first_today & (F.col("__day") == F.col("__first_day"))).cast("bigint").alias(new),
    )


def returning_flags(df: DataFrame, key: str, ts: str, gap_days: int = RETURN_GAP_DAYS) -> DataFrame:
    """One row per user and day with `uu_ct` = 1 and `back_ct` = 1 for a returning user."""
    return daily_visits(df, key, ts).select(
        key, "day", ts, F.lit(1).cast("bigint").alias("uu_ct"), is_returning(gap_days).alias("back_ct")
    )
