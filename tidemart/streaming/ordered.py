"""Visits, flags and bounces on streams.

First visits of a day and bounces are built-in operators: a drop of repeats and one windowed aggregate, both with
state the watermark evicts. Flag repair and visit history keep a small value per key in Python processors that
answer each micro-batch at once; they hold no rows and set no timers.

Rows without a time belong to no day and no window: they give no visit and no bounce, and flag repair lets them by.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemart.operators.sets import union_all

# Processors travel to the workers by value, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class FirstDay(StatefulProcessor):
    """Keeps the first day of a key and passes its rows by with that day.

    The first row of a key, the earliest of its first micro-batch, fixes the day: its own if it is flagged, else the
    day before. A run may start from days that were found before.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "day bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.first.update((initialState["first_day"],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.first.get()
        if held is None:
            # Only a key's first micro-batch is held, to find its earliest row.
            rows = list(rows)
            earliest = min(rows, key=lambda r: r["rank"])
            day = earliest["day"] - (earliest["flag"] != "1")
            self.first.update((day,))
        else:
            day = held[0]
        for row in rows:
            yield Row(payload=row["payload"], wrong=row["flag"] == "1" and row["day"] != day)

    def close(self) -> None:
        pass


class FirstByKey(StatefulProcessor):
    """Lets the first row of a key through, again once its state has outlived its time since it was written."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield Row(payload=next(rows)["payload"])

    def close(self) -> None:
        pass


class DayVisits(StatefulProcessor):
    """First visit of a key on each day, as it arrives, with the day visited before.

    Only key and time reach it, and a batch is cut to one time per day before state is read. State
    is the last day and the one before it, enough to place rows that are late across midnight.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "last string, before string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        firsts: dict[str, int] = {}
        for row in rows:
            day, us = row["day"], row["us"]
            # A row without a time is no visit.
            if day is not None and us < firsts.get(day, us + 1):
                firsts[day] = us
        if not firsts:
            return
        last, before = self.days.get() or (None, None)
        out = []
        for day in sorted(firsts):
            if day in (last, before):
                continue
            if last is None or day > last:
                out.append((firsts[day], day, last))
                last, before = day, last
            else:
                # The day is new but older than the last: not a first-ever visit, not a return.
                out.append((firsts[day], day, before or day))
                before = max(before or day, day)
        if not out:
            return
        self.days.update((last, before))
        # Rows the watermark has overtaken since they came in count at the watermark.
        floor = timerValues.getCurrentWatermarkInMs() * 1000
        for us, day, previous in out:
            yield Row(key=key[0], rt=EPOCH + timedelta(microseconds=max(us, floor)), day=day, previous_day=previous)

    def close(self) -> None:
        pass


def first_days(df: DataFrame, key: str, ts: str, flag: str, order: Sequence[str] = ()) -> DataFrame:
    """(key, first_day) of a stored table: what a later stream of flag repair starts from; days count from 1970."""
    known = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    flagged = F.min_by(F.coalesce(F.col(flag) == "1", F.lit(False)), F.struct(ts, *order))
    day = F.unix_date(F.to_date(F.min(ts)))
    return known.groupBy(key).agg((day - F.when(flagged, 0).otherwise(1)).cast("bigint").alias("first_day"))


def repair_is_new_stream(
    df: DataFrame, key: str, ts: str, flag: str, order: Sequence[str] = (), known: DataFrame | None = None
) -> DataFrame:
    """Streaming twin of `repair_is_new`: rows are answered in their own micro-batch, in order of arrival between batches.

    `known`, as `first_days` gives it, holds devices seen before the stream began. Rows cross to Python as one text
    next to the four values the rule reads, and come back as they went; rows without key or time pass by the state.
    """
    schema, timed = df.schema, F.col(key).isNotNull() & F.col(ts).isNotNull()
    ranks = [_sortable(F.col(o), schema[o].dataType) for o in order]
    slim = df.filter(timed).select(
        F.to_json(F.struct(F.col(key).alias("key"))).alias("__key"),
        F.concat_ws("\u0001", _sortable(F.unix_micros(F.col(ts).cast("timestamp")), T.LongType()), *ranks).alias("rank"),
        F.unix_date(F.to_date(ts)).cast("bigint").alias("day"),
        F.coalesce(F.col(flag), F.lit("")).alias("flag"),
        F.to_json(F.struct(*df.columns), _TIME).alias("payload"),
    )
    initial = None
    if known is not None:
        initial = known.filter(F.col(key).isNotNull()).select(F.to_json(F.struct(F.col(key).alias("key"))).alias("__key"), "first_day").groupBy("__key")
    out = slim.groupBy("__key").transformWithState(
        statefulProcessor=FirstDay(),
        outputStructType=T.StructType([T.StructField("payload", T.StringType()), T.StructField("wrong", T.BooleanType())]),
        outputMode="append",
        timeMode="None",
        initialState=initial,
    )
    rows = out.select(F.inline(F.array(F.from_json("payload", schema, _TIME))), F.col("wrong").alias("__wrong"))
    fixed = rows.withColumn(flag, F.when(F.col("__wrong"), "0").otherwise(F.col(flag))).drop("__wrong")
    return union_all(fixed, df.filter(~timed))


def first_by_key_stream(df: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """The first row of each key to arrive, and the next one after `ttl_seconds` of processing time, and so on.

    Where the time to live is one of event time, `operators.dedup.first_within` does the same without Python. Rows
    without a key are one key. State in processing time keeps a query going: give it a trigger that repeats or runs
    once, as one over what is available now does not end by itself.
    """
    slim = df.select(F.to_json(F.struct(F.col(key).alias("key"))).alias("__key"), F.to_json(F.struct(*df.columns), _TIME).alias("payload"))
    out = slim.groupBy("__key").transformWithState(
        statefulProcessor=FirstByKey(round(ttl_seconds * 1000)),
        outputStructType=T.StructType([T.StructField("payload", T.StringType())]),
        outputMode="append",
        timeMode="ProcessingTime",
    )
    return out.select(F.inline(F.array(F.from_json("payload", df.schema, _TIME))))


def _sortable(value: Column, kind: T.DataType) -> Column:
    """Text that sorts like the value, nulls first: whole numbers shifted above zero and padded."""
    if isinstance(kind, T.FractionalType):
        raise ValueError("order columns are whole numbers, texts or times")
    if isinstance(kind, T.IntegralType):
        shifted = value.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
        value = F.lpad(shifted.cast("string"), 20, "0")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("\u0002"), value.cast("string")))


def first_per_day_stream(
    df: DataFrame, key: str, ts: str, day_start: str = "0 seconds", order: Sequence[str] = ()
) -> DataFrame:
    """Streaming twin of `first_per_day`; its state goes when the day is over. Days are those of UTC moved by
    `day_start`: '16 hours' for UTC+8.

    Without `order` a row of each key and day comes at once: between micro-batches the first to arrive stays, and of
    several rows of a key and day in one micro-batch, which have no order among them, any one. With `order` it is the
    day's first by time and these columns, and comes when the watermark passes the day.
    """
    day = F.window(ts, "1 day", startTime=day_start)
    if order:
        first = F.min_by(F.struct(*df.columns), F.struct(ts, *order))
        return df.groupBy(day.alias("__day"), F.col(key).alias("__key")).agg(first.alias("__row")).select("__row.*")
    # The day takes the watermark over: Spark lets one event-time column decide when state goes, and here it is the day's end.
    plain = F.timestamp_micros(F.unix_micros(F.col(ts))).alias(ts)
    rows = df.withColumn("__day", day).select("__day", *(plain if c == ts else c for c in df.columns))
    return rows.dropDuplicates([key, "__day"]).drop("__day")


def daily_visits_stream(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Streaming twin of `daily_visits`: `key`, first `ts` of each day, `day` and `previous_day`.

    Answers with each micro-batch and keeps `ts` as event time for a window sum to follow.
    """
    key_type = df.schema[key].dataType
    slim = df.select(
        F.to_json(F.struct(key)).alias("__key"), F.col(ts).alias("__rt"),
        F.unix_micros(ts).alias("us"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
    )
    out = slim.groupBy("__key").transformWithState(
        statefulProcessor=DayVisits(),
        outputStructType=T.StructType(
            [
                T.StructField("key", T.StringType()),
                T.StructField("rt", T.TimestampType()),
                T.StructField("day", T.StringType()),
                T.StructField("previous_day", T.StringType()),
            ]
        ),
        outputMode="append",
        timeMode="EventTime",
        eventTimeColumnName="rt",
    )
    parsed = F.from_json("key", T.StructType([T.StructField(key, key_type)]))
    return out.select(
        parsed[key].alias(key), F.col("rt").alias(ts), F.to_date("day").alias("day"),
        F.to_date("previous_day").alias("previous_day"),
    )


def bounces_stream(
    df: DataFrame, key: str, ts: str, is_entry: Column, within_seconds: int = 10, order: Sequence[str] = (),
    slide_seconds: int | None = None,
) -> DataFrame:
    """Streaming twin of `bounces`, in one windowed aggregate.

    Windows start every `slide_seconds` and reach `within_seconds` past the next start, so that a window sees the
    successor of every row in its own part. A row stands in two windows by default. State is a window's rows per key,
    of which only entries carry their columns; no pairs are formed. Rows come out when the watermark passes their
    window: `slide_seconds + within_seconds` behind them at most.
    """
    slide = slide_seconds or within_seconds
    width, reach = slide * 1_000_000, within_seconds * 1_000_000
    entry = F.coalesce(is_entry, F.lit(False))
    rows = df.select(
        F.col(ts).alias("__rt"), F.col(key).alias("__key"),
        F.struct(
            F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
            (F.struct(*order) if order else F.lit(0)).alias("ord"),
            entry.alias("entry"),
            F.when(entry, F.struct(*df.columns)).alias("row"),
        ).alias("__r"),
    )
    window = F.window("__rt", f"{slide + within_seconds} seconds", f"{slide} seconds")
    held = rows.groupBy(window.alias("__w"), "__key").agg(F.collect_list("__r").alias("__rows"))
    # Sorted by time and order alone, as other columns need not be comparable.
    places = F.array_sort(F.transform("__rows", lambda r, i: F.struct(r["us"], r["ord"], r["entry"], i.alias("at"))))
    start = F.unix_micros("__w.start")

    def alone(r: Column, i: Column) -> Column:
        after = F.get("__places", i + 1)
        last = after.isNull() | (after["us"] - r["us"] >= reach) | after["entry"]
        own = (r["us"] >= start) & (r["us"] < start + width)
        return F.when(r["entry"] & own & last, F.get("__rows", r["at"])["row"])

    sorted_rows = held.select("__w", "__rows", places.alias("__places"))
    found = sorted_rows.select(F.explode(F.array_compact(F.transform("__places", alone))).alias("__row"))
    return found.select("__row.*")
