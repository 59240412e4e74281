"""Bounces: a session entry that no further page follows in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemart.operators.joins import time_bucket
from tidemart.operators.sets import union_all


def bounces(
    df: DataFrame,
    key: str,
    ts: str,
    is_entry: Column,
    within_seconds: int = 10,
    order: Sequence[str] = (),
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Entry rows whose next row on the same key is missing, `within_seconds` away, or an entry.

    The look-ahead is short, so a key is cut into time buckets and the rows that open a bucket
    are copied to the bucket before. One busy device then spreads over many tasks, and the
    copies are `within_seconds / bucket_seconds` of the input, by default a twentieth. Payload
    columns travel only with entry rows.
    """
    if bucket_seconds is None:
        bucket_seconds = max(600, 20 * within_seconds)
    if bucket_seconds <= within_seconds:
        raise ValueError("bucket_seconds must exceed within_seconds")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width, reach = bucket_seconds * 1_000_000, within_seconds * 1_000_000
    base = df.select(
        F.col(key).alias("__key"),
        micros.alias("__us"),
        F.struct(*order).alias("__ord") if order else F.lit(0).alias("__ord"),
        is_entry.alias("__entry"),
        F.when(is_entry, F.struct(*df.columns)).alias("__row"),
    ).withColumn("__bucket", time_bucket(F.col("__us"), width))
    opening = F.pmod("__us", F.lit(width)) < reach
    halo = base.filter(opening).select(
        "__key", "__us", "__ord", "__entry",
        F.lit(None).cast(base.schema["__row"].dataType).alias("__row"),
        (F.col("__bucket") - 1).alias("__bucket"),
    )
    w = Window.partitionBy("__key", "__bucket").orderBy("__us", "__ord")
    ahead = union_all(base, halo).select(
        "__row",
        "__us",
        F.lead("__us").over(w).alias("__next_us"),
        F.lead("__entry").over(w).alias("__next_entry"),
    )
    alone = (
        F.col("__next_us").isNull()
        | (F.col("__next_us") - F.col("__us") >= reach)
        | F.col("__next_entry")
    )
    return ahead.filter(F.col("__row").isNotNull() & alone).select("__row.*")
