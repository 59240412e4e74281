"""Change events and logs off raw text: each sound text is read once, and odd ones as before."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from tidemart.session import open_files
from tidemart.sources.text import parse_changes, store_changes, stored_changes


def texts(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_not_checked_apart_from_its_reading(spark):
    plan = plan_of(parse_changes(texts(spark, "{}")))
    assert not [line for line in plan.splitlines() if "Filter" in line and "parseJson" in line]


def test_strings_are_walked_whole_on_the_way_to_a_number(spark):
    """A match per string took most of the time of a text."""
    plan = plan_of(parse_changes(texts(spark, "{}")))
    assert plan.count("\\G(") >= 1 and "\u0001" not in plan


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ('{"a":1.10,"b":-0,"c":1E+05}', {"a": "1.10", "b": "-0", "c": "1E+05"}),
        ('{"a":"1.10, \\" 2","b":"]","c":"it\'s"}', {"a": '1.10, " 2', "b": "]", "c": "it's"}),
        ('{"a":' + "7" * 400 + "}", {"a": "7" * 400}),
        ('{"a":[1.0]}', {"a": '["1.0"]'}),
        ("5", None), ('"x"', None), ("{}", {}), ('{"a":null}', {"a": None}),
    ],
)
def test_sound_texts(spark, data, want):
    for text in ('{"table":"t","ts":17,"data":%s}', ' {"table":"t",\n"ts":"17","data":%s}\n'):
        row = parse_changes(texts(spark, text % data)).first()
        assert (row["table"], row["ts"], row["data"]) == ("t", 17, want)


@pytest.mark.parametrize(
    "text",
    ['{"a":01}', '{"a":1.}', '{"a":.5}', '{"a":+1}', '{"a":-}', '{"a":1-2}', '{"a":1 2}', "{1:2}", '{"a":{-5 :1}}', '{"a":"1"2}',
     '{"a":' + "1" * 1001 + "}", '{"a":NaN}', "{'a':1}", '{"a":"x\ty"}', '{"a":1},{"b":2}', '{"a":1}],[{}', '{"a":1}],"v":[{}',
     '{"a":1}}', '{"a":1} x', '{"data":5,"a":"\t}', '{"data":{,}}', '{"data":{"a":1}', "[]", "5"],
)
def test_broken_texts(spark, text):
    assert parse_changes(texts(spark, text)).count() == 0


def test_stored_without_a_shuffle(spark, folder):
    lines = [f'{{"table":"t{i % 3}","ts":{i},"data":{{"id":"{i}"}}}}' for i in range(30)]
    changes = parse_changes(texts(spark, *lines).coalesce(2))
    store_changes(changes, f"{folder}/stored")
    stored = stored_changes(spark, f"{folder}/stored")
    assert rows_of(stored, "table", "ts") == rows_of(changes, "table", "ts")
    # One file per task and table; rows dealt by table would lie in one each.
    assert len([name for name in stored.inputFiles() if "table=t1" in name]) == 2


def test_rows_are_not_sorted_by_table_before_they_are_stored(spark, folder):
    """The sort took a task's whole share of the topic through disk."""
    store_changes(parse_changes(texts(spark, '{"table":"a","ts":1,"data":{}}', '{"table":"b","ts":1,"data":{}}')), f"{folder}/unsorted")
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    (plan,) = [p for p in plans if f"{folder}/unsorted" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert "Sort" not in plan


def test_more_tables_than_open_files(spark, folder):
    lines = [f'{{"table":"t{i % 40}","ts":{i},"data":{{"id":"{i}"}}}}' for i in range(200)]
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    changes = parse_changes(texts(spark, *lines).coalesce(1))
    store_changes(changes, f"{folder}/many")
    assert rows_of(stored_changes(spark, f"{folder}/many"), "table", "ts") == rows_of(changes, "table", "ts")
    with pytest.raises(ValueError), open_files(spark, 3):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "3"
        raise ValueError
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_texts_of_other_tables_are_not_parsed(spark):
    lines = [
        '{"table":"a","ts":1,"data":{"x":"b"}}', '{"table":"b","ts":2,"data":{"x":1.50}}', '{ "data":{"table":"b"}, "table" : "a","ts":3}',
        r'{"table":"\u0062","ts":4}', '{"table":"b","ts":5', '{"table":null,"ts":6}', '{"ts":7}', '{"table":"bb","ts":8}', '{"table":"c","ts":9}', '"b"', "",
        r'{"table":"a","ts":10,"data":{"x":"\\"}}', '{"table":"b","table":"c","ts":11}', '{"table":"c","table":"b","ts":12}',
    ]
    every = parse_changes(texts(spark, *lines))
    for tables in (["b"], ["b", "c"], ["none"]):
        some = parse_changes(texts(spark, *lines), tables=tables)
        assert rows_of(some, "table", "ts", "data") == rows_of(every.filter(every["table"].isin(tables)), "table", "ts", "data")
    filters = [line for line in plan_of(parse_changes(texts(spark, *lines), tables=["b"])).splitlines() if "Filter" in line]
    assert any("Contains" in line and "from_json" not in line for line in filters)


def test_layers_leave_no_shuffle_files_and_are_packed_tightly(spark, folder, monkeypatch):
    """Shuffles of a layer stayed on disk beside those of the job above it, and texts were stored loosely."""
    import glob

    import registry
    from registry import Tables, layer

    monkeypatch.setattr(registry, "work_dir", lambda spark, name: f"{folder}/{name}")
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]
    before = set(glob.glob(f"{local}/**/shuffle_*", recursive=True))
    rows = layer(Tables(spark, folder), "swept", lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert rows.count() == 7
    kept = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True)) - before
    # What counted the rows just now remains; the layer's own shuffle had a file per map task. Files go in the background.
    for _ in range(50):
        if len(kept()) <= 1:
            break
        time.sleep(0.2)
    assert len(kept()) <= 1 and glob.glob(f"{folder}/swept/*.zstd.parquet")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_payments_come_off_the_topic_with_their_lines(spark, folder, monkeypatch):
    """Building and looking through the topic a second time for payments alone cost as much as the first."""
    from registry import Tables, dwd

    class Seen(Exception):
        pass

    def order_changes(t, *tables):
        raise Seen(set(tables))

    monkeypatch.setattr(dwd, "order_changes", order_changes)
    with pytest.raises(Seen) as seen:
        dwd.paid_lines(Tables(spark, folder))
    assert seen.value.args[0] == {"payment_info", "order_info", "order_detail", "order_detail_activity", "order_detail_coupon"}


def test_newest_lines_travel_once(spark):
    """Rows that keys and order name whole were sent beside a copy of themselves; results stay."""
    from tidemart.operators.dedup import latest_per_key

    df = spark.createDataFrame([("a", 1, None), ("a", 1, 5), ("a", 0, 9), (None, 2, 2), (None, 2, 3)], "id string, v int, w int")
    whole = latest_per_key(df, ["id"], ["v", "w"])
    assert whole.columns == ["id", "v", "w"] and sorted(whole.collect(), key=str) == sorted([("a", 1, 5), (None, 2, 3)], key=str)
    assert "max_by" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" in latest_per_key(df, ["id"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
