"""Streaming forms against their batch twins."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Window, functions as F

from helpers import rows_of, run, stream_of
from tidemart.operators.bounce import bounces
from tidemart.operators.dedup import first_per_day, first_within, latest_in_window
from tidemart.operators.visitors import daily_visits, repair_is_new
from tidemart.operators.windows import sums, tumble, tumble_distinct
from tidemart.streaming.sinks import to_files
from tidemart.streaming.ordered import (
    bounces_stream, daily_visits_stream, first_by_key_stream, first_days, first_per_day_stream, repair_is_new_stream,
)

SCHEMA = "k string, ms long, flag string, n int"
FAR = 4_000_000_000_000


def _batches(seed, n=120, keys=4, span_ms=3 * 86_400_000, late_ms=1500, parts=4):
    """Random rows, shuffled within the watermark delay, closed by a far-future row."""
    rng = random.Random(seed)
    rows = [
        (f"m{rng.randrange(keys)}", 1_700_000_000_000 + rng.randrange(span_ms), rng.choice("01"), i) for i in range(n)
    ]
    rows += [(r[0], r[1] + rng.choice([1000, 4000, 10_000, 11_000]), rng.choice("01"), n + i) for i, r in enumerate(rows)]
    rows.sort(key=lambda r: r[1] + rng.randrange(late_ms))
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)] + [[("end", FAR, "0", -1)]]


def _timed(df, delay="2 seconds"):
    return df.withColumn("rt", F.timestamp_millis("ms")).withWatermark("rt", delay)


def _both(spark, folder, seed):
    batches = _batches(seed)
    flat = [r for b in batches for r in b]
    return _timed(spark.createDataFrame(flat, SCHEMA)), _timed(stream_of(spark, folder, batches, SCHEMA))


def _no_end(df):
    return df.filter("k <> 'end'")


def test_repair_is_new(spark, folder):
    batch, stream = _both(spark, folder, 1)
    want = repair_is_new(batch, "k", "rt", "flag", ["n"]).select("k", "ms", "n", "flag")
    got = run(spark, folder, repair_is_new_stream(stream, "k", "rt", "flag", ["n"])).select("k", "ms", "n", "flag")
    assert rows_of(_no_end(got)) == rows_of(_no_end(want))


def test_repair_starts_from_stored_days(spark, folder):
    """A first run's table gives the days; the stream that follows gives the rows one run over both gives."""
    batches = [sorted(b, key=lambda r: r[1]) for b in _batches(7, late_ms=1)]
    old, new = batches[:2], batches[2:]
    flat = lambda parts: _timed(spark.createDataFrame([r for b in parts for r in b], SCHEMA))
    days = first_days(flat(old), "k", "rt", "flag", ["n"])
    stream = _timed(stream_of(spark, folder, new, SCHEMA))
    got = run(spark, folder, repair_is_new_stream(stream, "k", "rt", "flag", ["n"], known=days)).select("k", "ms", "n", "flag")
    numbers = {r[3] for b in new for r in b}
    whole = repair_is_new(flat(batches), "k", "rt", "flag", ["n"]).select("k", "ms", "n", "flag")
    want = [r for r in rows_of(whole) if r[2] in numbers]
    assert rows_of(got) == want
    fresh = repair_is_new(flat(new), "k", "rt", "flag", ["n"]).select("k", "ms", "n", "flag")
    assert rows_of(fresh) != want


def test_repair_lets_rows_without_key_or_time_by(spark, folder):
    rows = [[(None, 5, "1", 1), ("a", None, "1", 2), ("a", 1_700_000_000_000, "1", 2**60 + 1)], [("a", 1_800_000_000_000, "1", None), ("a", None, None, 4)]]
    stream = _timed(stream_of(spark, folder, rows, SCHEMA.replace("n int", "n long")))
    got = run(spark, folder, repair_is_new_stream(stream, "k", "rt", "flag", ["n"]))
    assert rows_of(got, "k", "flag", "n") == sorted([(None, "1", 1), ("a", "1", 2), ("a", "1", 2**60 + 1), ("a", "0", None), ("a", None, 4)], key=str)
    with pytest.raises(ValueError):
        repair_is_new_stream(stream.withColumn("x", F.lit(1.5)), "k", "rt", "flag", ["x"])


def _hot(seed):
    """A third of all rows on one device, close together in places."""
    batches = _batches(seed, n=150, keys=40)
    return [[("hot", *r[1:]) if r[0] != "end" and r[3] % 3 == 0 else r for r in b] for b in batches]


def test_first_per_day(spark, folder):
    for batches in (_batches(2), _hot(6)):
        flat = [r for b in batches for r in b]
        batch, stream = _timed(spark.createDataFrame(flat, SCHEMA)), _timed(stream_of(spark, folder, batches, SCHEMA))
        days = lambda df: rows_of(_no_end(df).select("k", F.to_date("rt").alias("day")))
        got = run(spark, folder, first_per_day_stream(stream, "k", "rt"))
        assert days(got) == days(first_per_day(batch, ["k"], "rt", ["n"]))
        assert set(rows_of(got, "k", "ms", "flag", "n")) <= set(flat)


def test_first_per_day_with_an_order_gives_the_first_row(spark, folder):
    batches = _batches(5)
    flat = [r for b in batches for r in b]
    batch, stream = _timed(spark.createDataFrame(flat, SCHEMA)), _timed(stream_of(spark, folder, batches, SCHEMA))
    got = run(spark, folder, first_per_day_stream(stream, "k", "rt", order=["n"]))
    want = _no_end(first_per_day(batch, ["k"], "rt", ["n"]))
    assert rows_of(_no_end(got), "k", "ms", "flag", "n") == rows_of(want, "k", "ms", "flag", "n")


def test_unique_visitor_query_gives_the_days_first_rows(spark, folder):
    from registry import Tables, streams

    day = "timestamp'2024-01-0{} {}'"
    rows = [(1, 7, day.format(2, "10:00:00")), (0, 7, day.format(2, "10:00:00")), (2, 7, day.format(3, "09:00:00")), (5, 7, "null"), (4, 7, "null"),
            (6, 8, day.format(2, "11:00:00")), (3, 8, day.format(2, "12:00:00")), (9, "null", day.format(1, "00:00:00"))]
    values = ",".join(f"(bigint({e}), bigint({u}), {ts})" for e, u, ts in rows)
    events = spark.sql(f"select *, 'view' as event_type, 1.0D as value, '' as props from values {values} as t(event_id, user_id, ts)")
    events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    got = streams.stream_unique_visitor(Tables(spark, folder))
    assert rows_of(got, "event_id", "user_id") == [(0, 7), (2, 7), (4, 7), (6, 8), (9, None)]


def test_first_per_day_forgets_days_that_are_over(spark, folder):
    day = 86_400_000
    batches = [[("a", 19_700 * day, "0", 0)], [("a", 19_700 * day + 5, "0", 1), ("b", 19_702 * day, "0", 2)], [("b", 19_702 * day + 1, "0", 3)], [("a", 19_700 * day + 6, "0", 4)]]
    stream = _timed(stream_of(spark, folder, batches, SCHEMA))
    assert rows_of(run(spark, folder, first_per_day_stream(stream, "k", "rt")), "n") == [(0,), (2,)]
    late = _timed(stream_of(spark, folder, [[("a", 19_700 * day - 1, "0", 0)], [("a", 19_700 * day + 1, "0", 1)], [("a", 19_700 * day + 2, "0", 2)]], SCHEMA))
    assert rows_of(run(spark, folder, first_per_day_stream(late, "k", "rt", "16 hours")), "n") == [(0,)]


def test_daily_visits_then_window(spark, folder):
    batches = [sorted(b, key=lambda r: r[1]) for b in _batches(3, late_ms=1)]
    flat = [r for b in batches for r in b]
    batch, stream = _timed(spark.createDataFrame(flat, SCHEMA)), _timed(stream_of(spark, folder, batches, SCHEMA))

    def windows(visits):
        rows = visits.withColumn("fresh", F.col("previous_day").isNull().cast("int"))
        return tumble(rows, "rt", "10 seconds", {"c": F.count("*"), **sums("fresh")}, ["k"], version=False)

    want = windows(daily_visits(batch, "k", "rt"))
    got = run(spark, folder, windows(daily_visits_stream(stream, "k", "rt")))
    assert rows_of(_no_end(got)) == rows_of(_no_end(want))
    assert got.count() > 5


def test_daily_visits_late_across_midnight(spark, folder):
    day = 86_400_000
    midnight = 19_700 * day
    batches = [
        [("a", midnight - 5 * day, "0", 0), ("b", midnight + 500, "0", 1)],
        [("a", midnight + 500, "0", 2)],
        [("a", midnight - 500, "0", 3), ("b", midnight - 500, "0", 4), ("b", midnight - 400, "0", 5)],
        [("end", FAR, "0", -1)],
    ]
    stream = _timed(stream_of(spark, folder, batches, SCHEMA))
    got = _no_end(run(spark, folder, daily_visits_stream(stream, "k", "rt")))
    per = got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("day").alias("d"),
                               F.sum(F.col("previous_day").isNull().cast("int")).alias("fresh"))
    assert rows_of(per, "k", "n", "d", "fresh") == [("a", 3, 3, 1), ("b", 2, 2, 1)]


def test_bounces(spark, folder):
    entry = F.col("flag") == "1"
    for batches, slide in ((_batches(4), None), (_hot(8), 4), (_batches(9, n=300, keys=2, span_ms=600_000), 25)):
        flat = [r for b in batches for r in b]
        batch, stream = _timed(spark.createDataFrame(flat, SCHEMA)), _timed(stream_of(spark, folder, batches, SCHEMA))
        want = bounces(batch, "k", "rt", entry, 10, ["n"]).select("k", "ms", "n")
        out = bounces_stream(stream, "k", "rt", entry, 10, ["n"], slide_seconds=slide).select("k", "ms", "n")
        got = run(spark, folder, out)
        assert rows_of(_no_end(got)) == rows_of(_no_end(want))
        assert 0 < got.count() < len(flat)


def test_no_python_worker_for_visitors_and_bounces(spark, folder):
    stream = _timed(stream_of(spark, folder, _batches(1), SCHEMA))
    for out in (first_per_day_stream(stream, "k", "rt"), bounces_stream(stream, "k", "rt", F.col("flag") == "1", 10, ["n"])):
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_latest_in_window_then_sum(spark, folder):
    batches = [
        [("a", 1_700_000_000_000, "x", 1), ("b", 1_700_000_001_000, "x", 5)],
        [("a", 1_700_000_000_000, "y", 2)],
        [("end", FAR, "0", -1)],
    ]
    stream = _timed(stream_of(spark, folder, batches, SCHEMA), "20 seconds")
    newest = latest_in_window(stream.select("k", "rt", "n", "flag"), ["k"], "rt", "10 seconds", ["n"])
    got = run(spark, folder, tumble(newest, "rt", "10 seconds", sums("n"), version=False))
    assert rows_of(got, "stt", "edt", "n") == [("2023-11-14 22:13:20", "2023-11-14 22:13:30", 7)]


def test_distinct_count_without_sets(spark, folder):
    batch, stream = _both(spark, folder, 5)
    args = ("rt", "10 seconds", "n", "cnt", ["ms"], ["k"])
    want = tumble_distinct(batch, *args, version=False)
    got = run(spark, folder, tumble_distinct(stream, *args, version=False))
    assert rows_of(_no_end(got)) == rows_of(_no_end(want))


def test_first_within_drops_repeats(spark, folder):
    t0 = 1_700_000_000_000
    batches = [[("a", t0, "x", 1)], [("a", t0 + 900, "y", 2), ("b", t0 + 900, "x", 3)], [("end", FAR, "0", -1)]]
    stream = stream_of(spark, folder, batches, SCHEMA).withColumn("rt", F.timestamp_millis("ms"))
    got = run(spark, folder, first_within(stream, ["k"], "rt", "10 seconds"))
    assert rows_of(_no_end(got), "k", "n") == [("a", 1), ("b", 3)]


def test_ties_go_by_value(spark, folder):
    t0 = 1_700_000_000_000
    batches = [[("a", t0, "1", 10), ("a", t0, "0", 9)], [("b", t0, "0", None), ("b", t0, "1", -3)], [("a", t0 + 86_400_000, "1", 1), ("b", t0 + 86_400_000, "1", 2)]]
    batches += [[("end", FAR, "0", -1)]]
    stream = _timed(stream_of(spark, folder, batches, SCHEMA))
    got = run(spark, folder, repair_is_new_stream(stream, "k", "rt", "flag", ["n"]))
    want = repair_is_new(_timed(spark.createDataFrame([r for b in batches for r in b], SCHEMA)), "k", "rt", "flag", ["n"])
    assert rows_of(got, "k", "n", "flag") == rows_of(want, "k", "n", "flag")
    # The day before the first counts as the first day of both, whose earliest rows were not flagged.
    assert ("a", 10, "0") in rows_of(got, "k", "n", "flag") and ("b", -3, "0") in rows_of(got, "k", "n", "flag")


@pytest.mark.parametrize("ttl, third", [(1.0, [("a", 3), ("b", 2)]), (3600.0, [("b", 2)])])
def test_state_with_a_time_to_live(spark, folder, ttl, third):
    """The stream is stopped and started again from its checkpoint; a key whose state has expired comes through again."""
    add = lambda *rows: spark.createDataFrame(list(rows), "k string, n int").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def step():
        stream = first_by_key_stream(spark.readStream.schema("k string, n int").parquet(f"{folder}/in"), "k", ttl)
        writer = to_files(stream, f"{folder}/out", f"{folder}/check").outputMode("append")
        assert writer.trigger(once=True).start().awaitTermination(120)
        return rows_of(spark.read.schema("k string, n int").parquet(f"{folder}/out"))

    add(("a", 1))
    assert step() == [("a", 1)]
    time.sleep(2)
    add(("a", 3), ("b", 2))
    assert step() == sorted([("a", 1), *third])


def test_day_visits_take_rows_as_they_come():
    """A data frame per key and micro-batch cost more than all else on a stream of many keys."""
    from pyspark.sql import Row

    from tidemart.streaming.ordered import EPOCH, DayVisits

    class State:
        held = None

        def get(self):
            return self.held

        def update(self, new):
            self.held = new

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 4

    visits = DayVisits()
    visits.days = State()
    rows = [Row(day=d, us=u) for d, u in (("2024-01-02", 9_000), ("2024-01-01", 5_000), ("2024-01-02", 7_000), (None, None), ("2024-01-01", 1_000))]
    micros = lambda out: [((r["rt"] - EPOCH).microseconds, r["day"], r["previous_day"], r["key"]) for r in out]
    assert micros(visits.handleInputRows(("k",), iter(rows), Timers())) == [(4_000, "2024-01-01", None, "k"), (7_000, "2024-01-02", "2024-01-01", "k")]
    assert visits.days.held == ("2024-01-02", "2024-01-01")
    assert micros(visits.handleInputRows(("k",), iter(rows[:1]), Timers())) == []
    late = [Row(day="2023-12-31", us=5_000), Row(day="2024-01-05", us=6_000)]
    assert micros(visits.handleInputRows(("k",), iter(late), Timers())) == [(5_000, "2023-12-31", "2024-01-01", "k"), (6_000, "2024-01-05", "2024-01-02", "k")]


def test_a_replay_has_a_file_per_core_in_every_micro_batch(spark, folder):
    """Two files a micro-batch left all but two cores idle while a topic was parsed."""
    from registry import Tables
    from registry.streams import in_time

    rows = spark.range(200_000).select("id", F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(200_000))).alias("at"))
    path, files = in_time(Tables(spark, folder), "per-core", rows, "at", [{"id": F.lit(-1), "at": F.lit("2100-01-01")}])
    assert files == min(spark.sparkContext.defaultParallelism, 5) > 1
    place = F.dense_rank().over(Window.orderBy("file_modification_time", "file_path"))
    placed = spark.read.parquet(path).select("id", "at", "_metadata.file_modification_time", "_metadata.file_path").withColumn("batch", F.floor((place - 1) / files))
    spans = placed.groupBy("batch").agg(F.min("at"), F.max("at"), F.count("*").alias("n")).orderBy("batch").collect()
    assert len(spans) == 5 and all(a[2] < b[1] for a, b in zip(spans, spans[1:])) and sum(s["n"] for s in spans) == 200_001


def test_first_by_key_keeps_its_state_on_the_heap(spark, folder, monkeypatch):
    """A state row in RocksDB cost more than all else in this stream; the setting is the session's own again afterwards."""
    import glob

    import registry
    from registry import streams
    from tidemart.session import ROCKSDB

    registry.load()
    monkeypatch.setattr(streams, "work_dir", lambda spark, name: f"{folder}/{name}")
    lines = spark.range(60).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "timestamp_ntz'1996-01-01 00:00:00' AS l_shipdate"
    )
    lines.write.parquet(f"{folder}/lineitem.parquet")
    got = [r[0] for r in registry.QUERIES["stream_first_by_key"](spark, folder).select("id").collect()]
    assert len(got) == len(set(got)) == 60
    state = glob.glob(f"{folder}/first-by-key/checkpoint/state/**", recursive=True)
    assert any(f.endswith(".delta") for f in state) and not any(f.endswith(".zip") for f in state)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKSDB
