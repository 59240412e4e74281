"""Parsing, routing, sinks and dashboards on literal records."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F, types as T

from helpers import rows_of
from tidemart import schemas
from tidemart.functions import times
from tidemart.functions.values import amount, camel, camel_names, product_text
from tidemart.operators import logs
from tidemart.operators.keywords import keyword_counts, words
from tidemart.operators.routing import dim_schema, latest_config, route_dimensions
from tidemart.operators.serve import gmv, on_day, uv_by_channel
from tidemart.plans import dashboard, dim, traffic
from tidemart.session import work_dir
from tidemart.sources.connectors import jdbc_options, jdbc_source, kafka_options, read_summary, store_summary
from tidemart.sources.text import parse_changes, parse_json, parse_logs, split_line
from tidemart.streaming.sinks import drain, kafka_rows, kafka_upserts
from tidemart.streaming.upsert import DimensionStore, UpsertTable, batch_rows

COMMON = {"mid": "m1", "is_new": "1", "ch": "web", "vc": "v1", "ar": "1", "uid": "7"}
PAGE = {"page_id": "home", "during_time": 5}
T0 = 1_704_067_200_000


def text(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in records], "value string")


def test_dirty_records_split_off(spark):
    df = text(spark, {"ts": 1}, "{'ts': 2}", '{"ts": 3} tail', "[1]", "12", "not json", '{"ts": 5},{"ts": 6}', '{"ts": 7}],{}', '{"ts": 8}}, {}', "", "  ", None, ' \n{"ts": 4}')
    good, dirty = parse_json(df, "value", T.StructType([T.StructField("ts", T.LongType())]))
    assert rows_of(good) == [(1,), (4,)]
    assert rows_of(dirty) == sorted([("{'ts': 2}",), ('{"ts": 3} tail',), ("[1]",), ("12",), ("not json",), ('{"ts": 5},{"ts": 6}',), ('{"ts": 7}],{}',), ('{"ts": 8}}, {}',)], key=str)


def _log(**parts):
    return {"common": COMMON, "ts": T0, **parts}


def test_log_fan_out(spark):
    raw = text(
        spark,
        _log(page=PAGE),
        _log(page=PAGE, err={"code": 1}, actions=[{"action_id": "cart_add", "item": "3", "ts": T0 + 9}],
             displays=[{"display_type": "query", "order": 1}, {"display_type": "promotion", "order": 2}]),
        _log(start={"entry": "icon"}, err={"code": 2}),
        "broken",
    )
    kinds = logs.split_log(parse_logs(raw))
    assert {k: df.count() for k, df in kinds.items()} == {"error": 2, "start": 1, "display": 2, "action": 1, "page": 2}
    action = kinds["action"].first()
    assert (action.ts, action.action_id, action.page.page_id, action.common.mid) == (T0, "cart_add", "home", "m1")
    assert kinds["start"].first().start == '{"entry":"icon"}'
    assert set(kinds["page"].columns) == {"common", "page", "ts"}

    values = {}
    for r in logs.fan_out(parse_logs(raw)).collect():
        values.setdefault(r.record, []).append(json.loads(r.value))
    assert {k: len(v) for k, v in values.items()} == {"error": 2, "start": 1, "display": 2, "action": 1, "page": 2}
    assert values["start"] == [{"common": COMMON, "start": {"entry": "icon"}, "ts": T0}]
    assert values["action"][0] == {"action_id": "cart_add", "item": "3", "common": COMMON, "page": PAGE, "ts": T0}
    assert {e["err"]["code"] for e in values["error"]} == {1, 2}
    assert "displays" in next(e for e in values["error"] if e["err"]["code"] == 1)


def test_page_filters(spark):
    page = lambda **p: _log(page=p)
    pages = parse_logs(
        text(
            spark, page(page_id="home"), page(page_id="login", last_page_id="home"), page(page_id="trade", last_page_id="home"),
            page(page_id="good_detail", last_page_id="search", item_type="keyword", item="red shoes"),
            {"common": {"mid": "m2"}, "page": {"page_id": "login"}, "ts": T0},
        )
    )
    ids = lambda df: sorted(r.page_id for r in df.select("page.page_id").collect())
    assert ids(logs.entry_pages(pages)) == ["home", "login"]
    assert ids(logs.pages_in(pages)) == ["good_detail", "home"]
    assert ids(logs.logins(pages)) == ["home", "login"]
    assert ids(logs.search_keywords(pages)) == ["good_detail"]


def test_home_visitors_are_counted(spark):
    pages = parse_logs(text(spark, *(_log(page={"page_id": p}) for p in ("home", "home", "good_detail"))))
    got = traffic.page_view_window(pages).first()
    assert (got.stt, got.home_uv_ct, got.good_detail_uv_ct) == ("2024-01-01 00:00:00", 1, 1)
    assert got.ts > T0


def test_words(spark):
    df = spark.createDataFrame([("Red  shoes, red!", 1), ("!!", 2), (None, 3), ("数据 Über", 4)], "t string, n int")
    assert rows_of(words(df, "t", keep=("n",))) == sorted(
        [(1, "red"), (1, "shoes"), (1, "red"), (4, "数据"), (4, "über")], key=str
    )
    timed = df.withColumn("rt", times.from_millis_floor(F.lit(T0 + 1999)))
    assert ("red", 2) in rows_of(keyword_counts(timed, "t", "rt"), "keyword", "keyword_count")


def test_time_and_amount_functions(spark):
    one = spark.createDataFrame([("2024-01-15 08:09:10", "bad", "3", "2.50")], "t string, b string, n string, p string")
    got = one.select(
        times.to_millis("t").alias("ms"), times.date_id("t").alias("d"), times.date_id("b").alias("bad"), times.date_prefix("t").alias("pre"),
        times.millis_to_full(times.to_millis("t")).alias("again"), product_text("n", "p").alias("x"), amount("b").alias("zero"), amount("p").alias("p"),
        times.today_number().alias("today"), times.version_seconds().alias("vs"),
    ).first()
    assert (got.ms, got.d, got.bad, got.pre, got.again) == (1705306150000, "2024-01-15", None, "2024-01-15", "2024-01-15 08:09:10")
    assert (got.x, got.zero, got.p) == ("7.5000", 0.0, 2.5)
    assert got.today > 20200101 and got.vs > T0 // 1000
    assert camel("ORDER_amount_x") == "orderAmountX"
    assert camel_names(spark.createDataFrame([(1,)], "user_id int")).columns == ["userId"]


def test_east_eight_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        ms = spark.range(1).select(times.to_millis(F.lit("2024-01-15 08:00:00")).alias("ms")).first().ms
        assert ms == 1705276800000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _change(table, kind, data, ts=1, **more):
    return {"database": "shop", "table": table, "type": kind, "ts": ts, "data": data, **more}


def _config(source, target, columns, pk=None):
    return {"source_table": source, "sink_table": target, "sink_columns": columns, "sink_pk": pk}


def test_config_feed_keeps_newest_and_ignores_deletes(spark):
    feed = text(
        spark, {"after": _config("a", "old", "id"), "op": "r", "ts_ms": 1}, {"after": _config("a", "dim_a", "id,name"), "op": "u", "ts_ms": 2},
        {"before": _config("a", "dim_a", "id,name"), "op": "d", "ts_ms": 3},
    )
    assert rows_of(dim.current_config(feed), "source_table", "sink_table") == [("a", "dim_a")]
    assert latest_config(spark.createDataFrame([], schemas.CONFIG_CHANGE)).count() == 0


def test_routing_keeps_exact_columns_and_known_types(spark):
    config = spark.createDataFrame([("a", "dim_a", "id, name", None, None)], schemas.DIM_CONFIG)
    rows = route_dimensions(
        parse_changes(
            text(spark, _change("a", "insert", {"id": "1", "name": "x", "z": "9"}), _change("a", "delete", {"id": "2"}), _change("b", "insert", {"id": "3"}))
        ),
        config,
    ).collect()
    assert [(r.sink_table, r.sink_pk, r.data) for r in rows] == [("dim_a", "id", {"id": "1"})]


def test_dim_schema():
    row = {"sink_columns": "id,name", "sink_pk": ""}
    assert [(f.name, f.nullable) for f in dim_schema(row)] == [("id", False), ("name", True)]


def test_dimension_stream(spark, folder):
    """Config present from the start, several tables per batch, quotes and NULLs survive, repeats change nothing."""
    config = [_config("a", "dim_a", "id,name"), _config("b", "dim_b", "code", "code")]
    text(spark, *({"after": c, "ts_ms": 1} for c in config)).coalesce(1).write.text(f"{folder}/config")
    text(
        spark, _change("a", "insert", {"id": "1", "name": "it's"}), _change("a", "insert", {"id": "2"}),
        _change("b", "bootstrap-insert", {"code": "k"}), _change("c", "insert", {"id": "1"}), "dirty",
    ).coalesce(1).write.text(f"{folder}/in")
    store, refused = DimensionStore(f"{folder}/store"), f"{folder}/dirty"
    assert store.read(spark, config[0]).count() == 0

    def step():
        raw = spark.readStream.text(f"{folder}/in")
        drain(dim.maintain_dimensions(spark, raw, f"{folder}/config", store, f"{folder}/check", refused), 120)

    step()
    assert rows_of(store.read(spark, config[0]), "id", "name") == [("1", "it's"), ("2", None)]
    assert rows_of(store.read(spark, config[1]), "code") == [("k",)]
    text(spark, _change("a", "update", {"id": "1", "name": "new"}, ts=2), _change("a", "update", {"id": "2", "name": "late"}, ts=0)).coalesce(1).write.mode(
        "append"
    ).text(f"{folder}/in")
    step()
    assert rows_of(store.read(spark, config[0]), "id", "name") == [("1", "new"), ("2", None)]
    folded = store.compact(spark, f"{folder}/folded")
    assert rows_of(folded.read(spark, config[0]), "id", "name") == [("1", "new"), ("2", None)]
    assert rows_of(batch_rows(spark, refused, T.StructType([T.StructField("value", T.StringType())])), "value", "batch_id") == [("dirty", 0)]


def test_upsert_table(spark, folder):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType()), T.StructField("ver", T.LongType()), T.StructField("gone", T.BooleanType())])
    table = UpsertTable(f"{folder}/t", schema, ["id"], ["ver"], "gone")
    assert table.read(spark).count() == 0
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    table.write_batch(batch(("a", None, 1, False), ("b", "x", 1, False), ("a", "c1", 2, False)), 0)
    table.write_batch(batch(("b", "x", 3, True), ("c", "y", 1, False)), 1)
    table.write_batch(batch(("b", "x", 3, True), ("c", "y", 1, False)), 1)
    want = [("a", "c1"), ("c", "y")]
    assert rows_of(table.read(spark), "id", "v") == want
    before = table.read(spark)
    table = table.compact(spark, f"{folder}/folded")
    assert rows_of(table.read(spark), "id", "v") == want
    assert rows_of(table.log(spark).select("batch_id").distinct()) == [(-1,)] and table.log(spark).count() == 3
    assert rows_of(before, "id", "v") == want, "a reader that began earlier keeps its files"
    table.write_batch(batch(("b", "late", 2, False)), 3)
    assert rows_of(table.read(spark), "id", "v") == want, "a deleted key does not come back with an old version"
    table.write_batch(batch(("c", "old", 0, False), ("c", "tie", 1, False)), 2)
    assert rows_of(table.read(spark), "id", "v") == [("a", "c1"), ("c", "tie")]


def test_upsert_stream_goes_on_from_its_checkpoint(spark, folder):
    """A stream stopped between batches and started again; a batch that runs twice counts once."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("ver", T.LongType())])
    table = UpsertTable(f"{folder}/t", schema, ["id"], ["ver"])
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def step():
        rows = spark.readStream.schema(schema).parquet(f"{folder}/in")
        drain(rows.writeStream.foreachBatch(table.write_batch).option("checkpointLocation", f"{folder}/check"), 120)

    add(("a", 1), ("b", 5))
    step()
    add(("a", 3), ("b", 2), ("c", 1))
    step()
    step()
    assert rows_of(table.log(spark)) == sorted([("a", 1, 0), ("b", 5, 0), ("a", 3, 1), ("b", 2, 1), ("c", 1, 1)], key=str)
    table.write_batch(spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], schema), 1)
    assert rows_of(table.read(spark)) == [("a", 3), ("b", 5), ("c", 1)]
    plan = table.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_kafka_rows(spark):
    df = spark.createDataFrame([("1", "x", False), ("2", None, True)], "id string, v string, gone boolean")
    assert rows_of(kafka_upserts(df, ["id"], "gone")) == [('{"id":"1"}', '{"id":"1","v":"x"}'), ('{"id":"2"}', None)]
    assert rows_of(kafka_rows(df.select("id"))) == [('{"id":"1"}',), ('{"id":"2"}',)]
    assert kafka_options("h:1", "t")["startingOffsets"] == "latest"
    assert jdbc_options("u", "a", "b", "d", fetchsize="9")["fetchsize"] == "9"


def test_lines(spark):
    assert rows_of(split_line(text(spark, "a,x,5", "b,y,oops"), ("id", "name", "ms"))) == [("a", "x", 5), ("b", "y", None)]


def test_summary_reads_newest_version(spark, folder):
    rows = [("s", "e", "k", 1, 10), ("s", "e", "k", 2, 20), ("s", "e", "j", 3, 10)]
    spark.createDataFrame(rows, "stt string, edt string, ch string, n int, ts long").write.parquet(f"{folder}/s")
    assert rows_of(read_summary(spark, f"{folder}/s", ["ch"]), "ch", "n") == [("j", 3), ("k", 2)]


def test_dashboards(spark):
    rows = [("2024-01-15 00:00:00", c, n) for c, n in [("b", 2), ("a", 2), ("c", 9), ("c", 1), ("d", 1)]] + [("2024-01-16 00:00:00", "z", 99)]
    df = spark.createDataFrame(rows, "stt string, ch string, uv_ct long").withColumn("order_amount", F.col("uv_ct") * 1.5)
    assert [(r.ch, r.uv, r.ct) for r in uv_by_channel(df, 20240115, 3).collect()] == [("c", 10, 2), ("a", 2, 1), ("b", 2, 1)]
    answer = json.loads(dashboard.channel_answer(df, 20240115, 3).first().payload)
    assert answer["data"] == {"categories": ["c", "a", "b"], "series": [{"name": "日活", "data": [10, 2, 2]}]}
    assert json.loads(dashboard.channel_answer(df, 20200101).first().payload)["data"]["categories"] == []
    assert gmv(df, 20240115).first().order_amount == 22.5
    assert json.loads(dashboard.gmv_answer(df, 20200101).first().payload) == {"status": 0, "msg": "", "data": None}
    assert df.filter(on_day(None)).count() == 0


def test_work_dir_follows_the_session():
    session = lambda **conf: SimpleNamespace(conf={k.replace("_", "."): v for k, v in conf.items()})
    assert work_dir(session(spark_checkpoint_dir="hdfs://shared/check/"), "x").startswith("hdfs://shared/check/x-")
    for master in ("local", "local[4]", "local[2,3]"):
        assert "tidemart-work" in work_dir(session(spark_master=master), "x")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_dir(session(spark_master=master), "x")


# A whole page record, with the values an application sends (fixed values).
SAMPLE = {
    "actions": [
        {"action_id": "favor_add", "item": "33", "item_type": "sku_id", "ts": 1651303989298},
        {"action_id": "cart_add", "item": "33", "item_type": "sku_id", "ts": 1651303993596},
    ],
    "common": {
        "ar": "440000", "ba": "iPhone", "ch": "Appstore", "is_new": "0", "md": "iPhone X", "mid": "mid_3442864", "os": "iOS 12.4.1",
        "uid": "928", "vc": "v2.1.134",
    },
    "displays": [
        {"display_type": "promotion", "item": "19", "item_type": "sku_id", "order": 1, "pos_id": 3},
        {"display_type": "query", "item": "27", "item_type": "sku_id", "order": 2, "pos_id": 4},
    ],
    "page": {
        "during_time": 17195, "item": "33", "item_type": "sku_id", "last_page_id": "good_list", "page_id": "good_detail",
        "source_type": "promotion",
    },
    "ts": 1651303985000,
}


def test_whole_sample_record_is_read(spark):
    row = parse_logs(text(spark, SAMPLE)).first().asDict(recursive=True)
    assert {k: row[k] for k in SAMPLE} == SAMPLE
    assert row["start"] is None and row["err"] is None


def test_summary_is_read_by_day(spark, folder):
    rows = [("2024-01-15 00:00:00", "2024-01-15 01:00:00", "a", 1, 5), ("2024-01-15 00:00:00", "2024-01-15 01:00:00", "a", 2, 6),
            ("2024-01-16 00:00:00", "2024-01-16 01:00:00", "a", 1, 9), ("2023-12-31 00:00:00", "2023-12-31 01:00:00", "b", 1, 7)]
    df = spark.createDataFrame(rows, "stt string, edt string, ch string, ts long, uv_ct long")
    store_summary(df.limit(2), f"{folder}/s")
    store_summary(df.filter("ch = 'b' OR uv_ct = 9"), f"{folder}/s")
    day = read_summary(spark, f"{folder}/s", ["ch"], 20240115)
    assert [(r.ch, r.uv_ct) for r in day.collect()] == [("a", 6)]
    plan = day._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "EqualTo(day,20240115)" in plan
    assert read_summary(spark, f"{folder}/s", ["ch"]).count() == 3


def test_jdbc_queries_stand_where_tables_do():
    assert jdbc_source(table="t") == "t" and jdbc_source(query="SELECT 1") == "(SELECT 1) AS source"
    with pytest.raises(ValueError):
        jdbc_source()
