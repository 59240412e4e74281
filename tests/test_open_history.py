"""Log fields beyond the layout, and routing by the config of an event's own time."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from helpers import rows_of
from tidemart.operators.logs import fan_out
from tidemart.plans import dim
from tidemart.plans.traffic import repair_logs
from tidemart.sources.text import _open, parse_logs
from tidemart.streaming.sinks import drain
from tidemart.streaming.upsert import DimensionStore


def record(**more):
    base = {"common": {"mid": "m", "is_new": "0"}, "page": {"page_id": "home"}, "ts": 1_704_067_200_000}
    return {**base, **more}


def fanned(spark, records, **options):
    raw = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in records], "value string")
    out = fan_out(repair_logs(parse_logs(raw, **options)))
    return sorted(((r.record, json.loads(r.value)) for r in out.collect()), key=str)


def test_unknown_fields_come_out_of_every_kind(spark):
    deep = {"a": [1, "1", None, {"b": 1.5}], "é": True}
    whole = record(
        trace=deep, none=None, number=12, common={"mid": "m", "is_new": "0", "imei": deep}, page={"page_id": "home", "depth": 3},
        displays=[{"item": "1", "slot": [1]}, {"item": "2"}], actions=[{"action_id": "x", "item": "3", "ts": 5, "why": "y"}], err={"code": 1},
    )
    got = dict((kind, [v for k, v in fanned(spark, [whole], open_fields=True) if k == kind]) for kind in ("action", "display", "error", "page", "start"))
    common, page, ts = whole["common"], whole["page"], whole["ts"]
    side = {"common": common, "page": page, "ts": ts}
    assert got["action"] == [{"action_id": "x", "item": "3", "why": "y", **side}]
    assert sorted(got["display"], key=str) == sorted([{"item": "1", "slot": [1], **side}, {"item": "2", **side}], key=str)
    assert got["page"] == [{**side, "trace": deep, "none": None, "number": 12}]
    assert got["error"] == [whole] and got["start"] == []
    start = record(start={"entry": "icon", "new": deep}, trace="t", common={"mid": "m", "imei": 1})
    assert fanned(spark, [start], open_fields=True) == [("start", {"common": start["common"], "start": start["start"], "ts": start["ts"], "trace": "t"})]


@pytest.mark.parametrize("one", [record(), record(page=None), record(common=None), record(displays=[]), record(displays=[{}]), {"ts": 1}, {}])
def test_records_without_unknown_fields_stay_as_they_were(spark, one):
    assert fanned(spark, [one], open_fields=True) == fanned(spark, [one])


def test_empty_log(spark):
    raw = spark.createDataFrame([], "value string")
    assert fan_out(repair_logs(parse_logs(raw, open_fields=True))).count() == 0


def config(source, target, columns, ms, op="u"):
    after = {"source_table": source, "sink_table": target, "sink_columns": columns}
    return json.dumps({"before": None, "after": after, "op": op, "ts_ms": ms})


CONFIG = [
    config("a", "first", "id,x", 50_000, "r"), config("a", "second", "id,y", 100_000), config("b", "late", "id", 100_000, "c"),
    json.dumps({"before": {"source_table": "a"}, "after": None, "op": "d", "ts_ms": 150_000}), config("c", "never", "id", 10**12, "c"),
]


def event(table, i, seconds):
    return json.dumps({"database": "s", "table": table, "type": "insert", "ts": seconds, "data": {"id": i, "x": "x", "y": "y"}})


EVENTS = [event("a", "1", 1), event("a", "2", 99), event("a", "3", 100), event("a", "4", 10_000), event("b", "5", 99), event("b", "6", 100), event("c", "7", 5)]
WANT = [("first", "1", "x", None), ("first", "2", "x", None), ("late", "6", None, None), ("second", "3", None, "y"), ("second", "4", None, "y")]


def text(spark, *lines):
    return spark.createDataFrame([(v,) for v in lines], "value string")


def test_events_go_by_the_config_of_their_time(spark):
    routed, _ = dim.route_raw(text(spark, *EVENTS), dim.past_config(text(spark, *CONFIG)), history=True)
    got = sorted(((r.sink_table, r.data["id"], r.data.get("x"), r.data.get("y")) for r in routed.collect()), key=str)
    assert got == WANT
    none, _ = dim.route_raw(text(spark, *EVENTS), dim.past_config(spark.createDataFrame([], "value string")), history=True)
    assert none.count() == 0


def test_a_replay_routes_as_the_first_run(spark, folder):
    """The first run meets the events before the config changes; a replay meets the whole config at once."""
    text(spark, CONFIG[0]).coalesce(1).write.text(f"{folder}/config")
    text(spark, *EVENTS[:2]).coalesce(1).write.text(f"{folder}/in")
    stores = []

    def step(name):
        store = DimensionStore(f"{folder}/{name}")
        drain(dim.maintain_dimensions(spark, spark.readStream.text(f"{folder}/in"), f"{folder}/config", store, f"{folder}/{name}-check", history=True), 120)
        stores.append(store)

    step("run")
    text(spark, *CONFIG[1:]).coalesce(1).write.mode("append").text(f"{folder}/config")
    text(spark, *EVENTS[2:]).coalesce(1).write.mode("append").text(f"{folder}/in")
    step("run")
    step("replay")
    rows = [
        [rows_of(s.read(spark, {"sink_table": t, "sink_columns": c, "sink_pk": ""})) for t, c in (("first", "id,x"), ("second", "id,y"), ("late", "id"))] for s in stores[1:]
    ]
    assert rows[0] == rows[1] == [[("1", "x"), ("2", "x")], [("3", "y"), ("4", "y")], [("6",)]]


def test_open_fields_are_read_once(spark):
    """Every field named outside of a lambda read the text again: two reads, of the layout and of the whole, are enough."""
    rows = spark.createDataFrame([("{}",)], "value string").select(_open(F.col("value")).alias("open"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2
