"""Joins against brute force, and their streaming forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, run, stream_of
from tidemart.operators.enrich import add_catalog_keys, add_catalog_names, enrich, flatten_catalog, lookup
from tidemart.operators.joins import bounded_join, interval_join
from tidemart.operators.windows import tumble

BASE = datetime(2024, 1, 1)
LEFT, RIGHT = "id string, name string, lms long", "rid string, sex string, rms long"


def _typed(df, ms, name):
    return df.withColumn(name, F.timestamp_millis(ms))


def _sides(spark, left, right):
    return _typed(spark.createDataFrame(left, LEFT), "lms", "lt"), _typed(spark.createDataFrame(right, RIGHT), "rms", "rt")


def test_interval_ends_are_included(spark):
    left, right = _sides(spark, [("a", "x", 10_000)], [("a", str(d), 10_000 + d) for d in (-3, -2, -1, 0, 1, 2)])
    got = interval_join(left, right, [("id", "rid")], "lt", "rt", -0.002, 0.001)
    assert rows_of(got, "sex") == [("-1",), ("-2",), ("0",), ("1",)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("lower,upper", [(-0.02, 0.01), (0, 0), (0.005, 0.030)])
def test_interval_join_against_brute_force(spark, how, lower, upper):
    rng = random.Random(3)
    left = [(rng.choice("ab"), f"l{i}", 1000 + rng.randrange(200)) for i in range(60)] + [(None, "ln", 1000)]
    right = [(rng.choice("abc"), f"r{i}", 1000 + rng.randrange(200)) for i in range(60)] + [(None, "rn", 1000)]
    lo, hi = round(lower * 1000), round(upper * 1000)
    pairs = [(l, r) for l in left for r in right if l[0] and l[0] == r[0] and lo <= r[2] - l[2] <= hi]
    hit_l, hit_r = {l[1] for l, _ in pairs}, {r[1] for _, r in pairs}
    both = [(l[1], r[1]) for l, r in pairs]
    only_l = [(l[1], None) for l in left if l[1] not in hit_l]
    only_r = [(None, r[1]) for r in right if r[1] not in hit_r]
    want = {
        "inner": both, "left": both + only_l, "right": both + only_r, "full": both + only_l + only_r,
        "left_semi": [(n,) for n in hit_l], "left_anti": [(l,) for l, _ in only_l],
    }[how]
    a, b = _sides(spark, left, right)
    got = interval_join(a, b, [("id", "rid")], "lt", "rt", lower, upper, how)
    cols = ("name",) if how.startswith("left_") else ("name", "sex")
    assert rows_of(got, *cols) == sorted(want, key=str)


def test_interval_before_epoch_and_bad_arguments(spark):
    a, b = _sides(spark, [("a", "x", -10_001)], [("a", "y", -10_002), ("a", "z", -9_000)])
    assert rows_of(interval_join(a, b, [("id", "rid")], "lt", "rt", -0.002, 0.001), "sex") == [("y",)]
    with pytest.raises(ValueError):
        interval_join(a, b, [("id", "rid")], "lt", "rt", 1, 0)
    with pytest.raises(ValueError):
        interval_join(a, b, [("id", "rid")], "lt", "rt", 0, 1, "cross")


def test_interval_plan_splits_a_key_along_time(spark):
    a, b = _sides(spark, [("a", "x", 1)], [("a", "y", 1)])
    plan = interval_join(a, b, [("id", "rid")], "lt", "rt", -1, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "__l_bucket" in plan.split("Join", 1)[1].split("\n")[0]


FAR = 4_000_000_000_000


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_streaming_join_variants(spark, folder, how):
    t0 = 1_700_000_000_000
    left = [[("a", "l1", t0), ("b", "l2", t0)], [("a", "l3", t0 + 60_000)], [("end", "end", FAR)]]
    right = [[("a", "r1", t0 + 2_000)], [("a", "r2", t0 + 66_000), ("c", "r3", t0)], [("end", "end", FAR)]]
    flat = lambda batches: [r for batch in batches for r in batch]
    a, b = _sides(spark, flat(left), flat(right))
    want = bounded_join(a, b, [("id", "rid")], how, "lt", "rt", 5.0)
    sa = _typed(stream_of(spark, folder, left, LEFT), "lms", "lt").withWatermark("lt", "2 seconds")
    sb = _typed(stream_of(spark, folder, right, RIGHT), "rms", "rt").withWatermark("rt", "2 seconds")
    got = run(spark, folder, bounded_join(sa, sb, [("id", "rid")], how, "lt", "rt", 5.0))
    strip = lambda df: [r for r in rows_of(df, "name", "sex") if "end" not in r]
    assert strip(got) == strip(want)


def _dims(spark):
    text = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    return dict(
        sku=text([("1", "10", "30", "7"), ("2", "10", "31", "8")], ["id", "spu_id", "category3_id", "tm_id"]),
        spu=text([("10", "phone")], ["id", "spu_name"]), trademark=text([("7", "acme")], ["id", "tm_name"]),
        category3=text([("30", "c3", "20")], ["id", "name", "category2_id"]),
        category2=text([("20", "c2", "9")], ["id", "name", "category1_id"]), category1=text([("9", "c1")], ["id", "name"]),
    )


def test_missing_dimension_keeps_the_row(spark):
    df = spark.createDataFrame([("99",), ("1",)], "province_id string")
    dim = spark.createDataFrame([("1", "north")], "id string, name string")
    assert rows_of(enrich(df, dim, "province_id", {"NAME": "province_name"})) == [("1", "north"), ("99", None)]


def test_lookup_drops_unknown_codes_and_takes_two_aliases(spark):
    dic = spark.createDataFrame([("1", "one"), ("2", "two")], "dic_code string, dic_name string")
    df = spark.createDataFrame([("1", "2"), ("1", "3")], "a string, b string")
    got = lookup(lookup(df, dic, "a", "a_name"), dic, "b", "b_name")
    assert rows_of(got, "a_name", "b_name") == [("one", "two")]


def test_catalog_levels(spark):
    dims = _dims(spark)
    names = ["spu_name", "trademark_name", "category3_name", "category2_name", "category1_name"]
    flat = flatten_catalog(**dims)
    assert rows_of(flat, "sku_id", *names) == [("1", "phone", "acme", "c3", "c2", "c1"), ("2", "phone", None, None, None, None)]
    sales = spark.createDataFrame([("1",), ("2",), ("3",)], "sku_id string")
    keyed = add_catalog_keys(sales, dims.pop("sku"))
    assert rows_of(add_catalog_names(keyed, **dims), "sku_id", *names) == [
        ("1", "phone", "acme", "c3", "c2", "c1"), ("2", "phone", None, None, None, None), ("3", None, None, None, None, None)
    ]


def test_small_dimension_is_broadcast_by_size_not_by_hint(spark):
    dim = spark.createDataFrame([("1", "north")], "id string, name string")
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    plan = enrich(df, dim, "k", {"name": "n"})._jdf.queryExecution().analyzed().toString()
    assert "hint" not in plan.lower() and "strategy=broadcast" not in plan


def test_window_labels(spark):
    df = spark.createDataFrame([(BASE + timedelta(seconds=s),) for s in (0, 9, 10)], "t timestamp")
    got = tumble(df, "t", "10 seconds", {"n": F.count("*")})
    assert got.columns == ["stt", "edt", "n", "ts"]
    assert rows_of(got, "stt", "edt", "n") == [
        ("2024-01-01 00:00:00", "2024-01-01 00:00:10", 2), ("2024-01-01 00:00:10", "2024-01-01 00:00:20", 1)
    ]


def test_a_shuffle_is_cut_by_size_not_by_a_fixed_number(spark):
    """With a fixed number of partitions, what a task holds grows with the input."""
    rows = spark.range(4_000_000).select(F.expr("uuid()").alias("key"))
    counted = rows.groupBy("key").count().select(F.spark_partition_id().alias("part")).groupBy("part").count()
    parts = counted.count()
    assert parts > 4 and spark.range(100).groupBy("id").count().select(F.spark_partition_id().alias("part")).distinct().count() <= 4
