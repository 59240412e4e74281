"""Hand-computed results of every keyed rule, and skew-safe forms against plain windows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from helpers import rows_of
from tidemart.operators.bounce import bounces
from tidemart.operators.changes import became, change_events, changed, positive_delta
from tidemart.operators.dedup import first_per_day, first_per_key, latest_per_key
from tidemart.operators.hotkeys import attach_per_key
from tidemart.operators.visitors import daily_visits, first_flags, repair_is_new, returning_flags

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def at(text):
    return datetime.fromisoformat(text)


def test_is_new_repair(spark):
    rows = [
        ("m1", at("2024-01-01 08:00:00"), "1", 1), ("m1", at("2024-01-01 09:00:00"), "1", 2),
        ("m1", at("2024-01-02 08:00:00"), "1", 3), ("m2", at("2024-01-01 08:00:00"), "0", 4),
        ("m2", at("2024-01-01 09:00:00"), "1", 5), (None, at("2024-01-01 09:00:00"), "1", 6),
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp, flag string, n int")
    for hot in (1, 1000):
        got = {r.n: r.flag for r in repair_is_new(df, "k", "ts", "flag", ["n"], hot_rows=hot).collect()}
        assert got == {1: "1", 2: "1", 3: "0", 4: "0", 5: "0", 6: "1"}


def _entries(spark, *rows):
    data = [("m", at("2024-01-01 00:00:00").timestamp() + s, entry, i) for i, (s, entry) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, s double, entry boolean, n int")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))


def test_bounce(spark):
    df = _entries(spark, (0, True), (5, True), (20, True), (25, False))
    assert rows_of(bounces(df, "k", "ts", F.col("entry"), 10, ["n"]), "n") == [(0,), (1,)]


@pytest.mark.parametrize("gap,is_bounce", [(9.999, False), (10.0, True)])
def test_bounce_boundary(spark, gap, is_bounce):
    df = _entries(spark, (0, True), (gap, False))
    assert (bounces(df, "k", "ts", F.col("entry"), 10, ["n"]).count() == 1) == is_bounce


def test_bounce_across_buckets_equals_plain_lead(spark):
    import random

    rng = random.Random(7)
    df = _entries(spark, *((rng.uniform(0, 3000), rng.random() < 0.5) for _ in range(400)))
    w = Window.partitionBy("k").orderBy("ts", "n")
    plain = (
        df.withColumn("nt", F.lead("s").over(w)).withColumn("ne", F.lead("entry").over(w))
        .filter("entry and (nt is null or ne)").union(
            df.withColumn("nt", F.lead("s").over(w)).withColumn("ne", F.lead("entry").over(w))
            .filter("entry and nt is not null and not ne and unix_micros(timestamp_micros(cast(nt * 1000000 as bigint))) - unix_micros(ts) >= 10000000")
        )
    )
    for bucket in (11, 60, 100_000):
        got = bounces(df, "k", "ts", F.col("entry"), 10, ["n"], bucket_seconds=bucket)
        assert rows_of(got, "n") == rows_of(plain, "n")
    with pytest.raises(ValueError):
        bounces(df, "k", "ts", F.col("entry"), 10, ["n"], bucket_seconds=10)


@pytest.mark.parametrize("second,back", [("2024-01-08", 0), ("2024-01-09", 1)])
def test_returning_user_needs_more_than_seven_days(spark, second, back):
    df = spark.createDataFrame([("u", at("2024-01-01 23:00:00")), ("u", at(f"{second} 01:00:00"))], "k string, ts timestamp")
    got = returning_flags(df, "k", "ts").orderBy("day").collect()
    assert [(r.uu_ct, r.back_ct) for r in got] == [(1, 0), (1, back)]


def test_first_flags(spark):
    rows = [("u", at("2024-01-01 01:00:00"), 1), ("u", at("2024-01-01 02:00:00"), 2), ("u", at("2024-01-02 01:00:00"), 3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n int")
    for hot in (1, 1000):
        got = first_flags(df, "k", "ts", ["n"], hot_rows=hot).orderBy("n").collect()
        assert [(r.is_new_user, r.is_unique) for r in got] == [(1, 1), (0, 0), (0, 1)]


def test_latest_per_key_prefers_version_then_arrival(spark):
    rows = [("a", 1, 0, None), ("a", 2, 1, "c1"), ("b", 5, 0, "x"), ("b", 5, 1, "y")]
    df = spark.createDataFrame(rows, "k string, v int, arrival int, coupon string")
    assert rows_of(latest_per_key(df, ["k"], ["v", "arrival"]), "k", "coupon") == [("a", "c1"), ("b", "y")]
    assert rows_of(first_per_key(df, ["k"], ["v", "arrival"]), "k", "coupon") == [("a", None), ("b", "x")]


def test_cart_delta(spark):
    rows = [
        ("1", "insert", {"n": "2"}, None), ("2", "update", {"n": "5"}, {"n": "2"}), ("3", "update", {"n": "3"}, {"n": "5"}),
        ("4", "update", {"n": "3"}, {"checked": "0"}), ("5", "update", {"n": "many"}, {"n": "5"}), ("6", "delete", {"n": "1"}, None),
    ]
    df = spark.createDataFrame(rows, "id string, type string, data map<string,string>, old map<string,string>")
    assert rows_of(positive_delta(df, "n"), "id", "n") == [("1", "2"), ("2", "3")]


def test_change_event_predicates(spark):
    rows = [
        ("shop", "t", "update", {"s": "1402", "id": "1"}, {"s": "1401"}), ("shop", "t", "update", {"s": "1402", "id": "2"}, {"x": "1"}),
        ("shop", "t", "insert", {"s": "1402", "id": "3"}, None), ("other", "t", "update", {"s": "1402", "id": "4"}, {"s": "1401"}),
        ("shop", "u", "update", {"s": "1402", "id": "5"}, {"s": "1401"}), ("shop", "t", "update", {"s": "1403", "id": "6"}, {"s": "1400"}),
    ]
    df = spark.createDataFrame(rows, "database string, table string, type string, data map<string,string>, old map<string,string>")
    pick = lambda **kw: [r.id for r in change_events(df, "t", ["id"], **kw).orderBy("id").collect()]
    assert pick(types=["update"], where=became("s", "1402", "1401")) == ["1", "4"]
    assert pick(types=["update"], where=became("s", "1402", "1401"), database="shop") == ["1"]
    assert pick(where=changed("s")) == ["1", "4", "6"]
    assert change_events(df, "t", {"gone": "nope"}).filter("gone is not null").count() == 0


def test_attach_keeps_every_row(spark):
    rows = [("hot", i) for i in range(50)] + [("a", 50), ("b", 51), (None, 52)]
    df = spark.createDataFrame(rows, "k string, n int")
    state = df.filter("k <> 'b'").groupBy("k").agg(F.max("n").alias("top"), F.count("*").alias("c"))
    for hot in (10, 1000):
        got = rows_of(attach_per_key(df, state, ["k"], "c", hot), "n", "top")
        assert got == sorted([(i, 49) for i in range(50)] + [(50, 50), (51, None), (52, None)], key=str)


visits = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 4), st.integers(0, 86_399), st.integers(0, 99)), min_size=1, max_size=25,
    unique_by=lambda r: r[:3],
)


@FEW
@given(visits, st.integers(1, 5))
def test_first_per_day_whatever_the_partitioning(spark, rows, parts):
    data = [(k, datetime(2024, 1, 1 + d, s // 3600, s // 60 % 60, s % 60), n) for k, d, s, n in rows]
    df = spark.createDataFrame(data, "k string, ts timestamp, n int").repartition(parts)
    want = {}
    for k, t, n in sorted(data):
        want.setdefault((k, t.date()), (k, t, n))
    got = [(r.k, r.ts, r.n) for r in first_per_day(df, ["k"], "ts", ["n"]).collect()]
    assert sorted(got) == sorted(want.values())
    days = {(r.k, r.day): r.previous_day for r in daily_visits(df, "k", "ts").collect()}
    for (k, day), previous in days.items():
        assert previous == max((d for kk, d in want if kk == k and d < day), default=None)
    assert isinstance(next(iter(days))[1], date)


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=30), st.integers(1, 4))
def test_latest_per_key_whatever_the_partitioning(spark, rows, parts):
    data = [(k, v, a, i) for i, (k, v, a) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, v int, a int, i int").repartition(parts)
    want = {}
    for r in sorted(data, key=lambda r: (r[1], r[2], r[3])):
        want[r[0]] = r
    assert sorted(tuple(r) for r in latest_per_key(df, ["k"], ["v", "a", "i"]).collect()) == sorted(want.values())
