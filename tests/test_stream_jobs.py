"""Whole jobs as streams give the rows of the same jobs over tables."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, run, stream_of
from tidemart.plans import tools, trade, traffic
from tidemart.operators.joins import bounded_join
from tidemart.operators.windows import tumble
from tidemart.sources.text import parse_changes, parse_logs
from tidemart.streaming.sinks import drain, to_files

T0 = 1_704_067_200
FAR = 4_000_000_000
_serial = itertools.count()


def change(table, kind, ts, data, old=None):
    record = {"database": "shop", "table": table, "type": kind, "ts": ts, "xoffset": next(_serial), "data": data}
    return json.dumps(record if old is None else {**record, "old": old})


def line(i, order, ts, **more):
    return change(
        "order_detail", "insert", ts,
        {"id": i, "order_id": order, "sku_id": "1", "sku_name": "s", "create_time": "2024-01-01 00:00:00", "source_id": "9", "source_type": "2401",
         "sku_num": "2", "order_price": "3.5", "split_total_amount": "7", **more},
    )


ORDERS = [
    [
        change("order_info", "insert", T0, {"id": "o1", "user_id": "u1", "province_id": "p", "order_status": "1001"}),
        line("d1", "o1", T0), line("d2", "o1", T0 + 1),
        change("order_detail_activity", "insert", T0, {"order_detail_id": "d1", "activity_id": "a1", "activity_rule_id": "r1"}),
    ],
    [
        change("order_detail_coupon", "insert", T0 + 2, {"order_detail_id": "d2", "coupon_id": "c1"}),
        change("order_info", "update", T0 + 3, {"id": "o1", "user_id": "u1", "order_status": "1003", "operate_time": "2024-01-01 00:00:03"}, {"order_status": "1001"}),
        line("d3", "gone", T0), line("d4", "o1", T0, source_type="9999"),
    ],
    [
        change("order_info", "insert", FAR, {"id": "end"}), line("end", "end", FAR),
        change("order_detail_activity", "insert", FAR, {"order_detail_id": "x"}), change("order_detail_coupon", "insert", FAR, {"order_detail_id": "x"}),
    ],
]


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame([("2401", "web"), ("1101", "card")], "dic_code string, dic_name string")


def both(spark, folder, batches):
    flat = [(v,) for b in batches for v in b]
    return (
        spark.createDataFrame(flat, "value string"),
        stream_of(spark, folder, [[(v,) for v in b] for b in batches], "value string"),
    )


def test_order_pre_process(spark, folder, dictionary):
    table, stream = both(spark, folder, ORDERS)
    cols = ["id", "type", "order_status", "activity_id", "coupon_id", "split_original_amount", "source_type_name"]
    want = rows_of(trade.order_pre_process(parse_changes(table), dictionary, "shop").filter("id <> 'end'"), *cols)
    got = run(spark, folder, trade.order_pre_process(parse_changes(stream), dictionary, "shop").drop("old"))
    assert rows_of(got.filter("id <> 'end'"), *cols) == want
    assert want == sorted(
        [
            ("d1", "insert", "1001", "a1", None, "7.0000", "web"), ("d1", "update", "1003", "a1", None, "7.0000", "web"),
            ("d2", "insert", "1001", None, "c1", "7.0000", "web"), ("d2", "update", "1003", None, "c1", "7.0000", "web"),
        ], key=str,
    )
    pre = trade.order_pre_process(parse_changes(table), dictionary, "shop")
    assert rows_of(trade.cancel_detail(pre), "id", "cancel_time", "date_id") == [
        ("d1", "2024-01-01 00:00:03", "2024-01-01"), ("d2", "2024-01-01 00:00:03", "2024-01-01")
    ]


DETAIL = (
    "id string, order_id string, user_id string, sku_id string, province_id string, create_time string, split_original_amount string, "
    "split_activity_amount string, split_coupon_amount string, split_total_amount string, row_op_ts timestamp, n int"
)


def detail(i, order, user, time, version, activity=None, n=0):
    from datetime import datetime

    return (i, order, user, "1", "p1", time, "10", activity, None, "8", datetime.fromisoformat(f"2024-01-01 00:00:{version:02d}"), n)


DETAILS = [
    [
        detail("d1", "o1", "u1", "2024-01-01 10:00:01", 1), detail("d1", "o1", "u1", "2024-01-01 10:00:01", 2, "1.5"),
        detail("d2", "o1", "u1", "2024-01-01 10:00:02", 1), detail("d3", "o2", "u2", "2024-01-01 10:00:05", 1),
    ],
    [detail("d4", "o3", "u1", "2024-01-01 10:00:12", 1), detail("d5", "o4", "u1", "2024-01-02 09:00:00", 1)],
    [detail("end", "end", "end", "2090-01-01 00:00:00", 1)],
]


def both_details(spark, folder):
    flat = [r for b in DETAILS for r in b]
    return spark.createDataFrame(flat, DETAIL), stream_of(spark, folder, DETAILS, DETAIL)


def closed(df):
    return df.filter("stt < '2090'")


def test_order_window(spark, folder):
    table, stream = both_details(spark, folder)
    want = closed(trade.order_window(table, version=False, order=("n",)))
    got = closed(run(spark, folder, trade.order_window(stream, version=False, order=("n",))))
    assert rows_of(got) == rows_of(want)
    first = want.orderBy("stt").first()
    assert (first.order_unique_user_count, first.order_new_user_count, first.order_activity_reduce_amount) == (2, 2, 1.5)
    assert first.order_origin_total_amount == 30.0


def test_user_spu_and_province_windows(spark, folder):
    table, stream = both_details(spark, folder)
    text = lambda rows, *cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    dims = dict(
        sku=text([("1", "s", "c", "t")], "id", "spu_id", "category3_id", "tm_id"), spu=text([("s", "spu")], "id", "spu_name"),
        trademark=text([("t", "tm")], "id", "tm_name"), category3=text([("c", "c3", "b")], "id", "name", "category2_id"),
        category2=text([("b", "c2", "a")], "id", "name", "category1_id"), category1=text([("a", "c1")], "id", "name"),
    )
    jobs = [
        lambda d: trade.user_spu_window(d, **dims, version=False, order=("n",)),
        lambda d: trade.province_window(d, text([("p1", "north")], "id", "name"), version=False, order=("n",)),
    ]
    for job in jobs:
        want = closed(job(table))
        assert rows_of(closed(run(spark, folder, job(stream)))) == rows_of(want)
    province = want.orderBy("stt").first()
    assert (province.province_name, province.order_count, province.order_amount) == ("north", 2, 24.0)


def log(mid, ms, page, last=None, uid=None, flag="0"):
    return json.dumps(
        {"common": {"mid": mid, "uid": uid, "is_new": flag, "ch": "c", "vc": "v", "ar": "a"}, "ts": T0 * 1000 + ms,
         "page": {"page_id": page, "last_page_id": last, "during_time": 3, "item": "Red Hat", "item_type": "keyword"}}
    )


DAY = 86_400_000
LOGS = [
    [log("m1", 0, "home", uid="7", flag="1"), log("m1", 4_000, "good_detail", "home"), log("m2", 5_000, "home")],
    [log("m2", 8_000, "home"), log("m1", 9 * DAY, "home", uid="7", flag="1"), log("m1", 9 * DAY + 1, "list", "search")],
    [log("end", 900 * DAY, "home", uid="end"), log("end", 900 * DAY + 1, "list", "search")],
]


@pytest.mark.parametrize("job", [traffic.page_view_window, traffic.login_window, traffic.keyword_window])
def test_traffic_windows(spark, folder, job):
    table, stream = both(spark, folder, LOGS)
    want = closed(job(parse_logs(table), version=False)).filter("stt < '2026'")
    got = closed(run(spark, folder, job(parse_logs(stream), version=False))).filter("stt < '2026'")
    assert rows_of(got) == rows_of(want)
    assert want.count() >= 1


def test_a_joined_partition_keeps_one_store_and_commits_its_changes(spark, folder):
    """Four stores a partition, each written whole with every micro-batch, cost more than the joins themselves."""
    import glob

    side = lambda name: stream_of(spark, folder, [[(1, 5)], [(2, 6)], [(3, 4_000_000_000)]], f"{name}k int, {name}s long").withColumn(
        f"{name}t", F.timestamp_seconds(f"{name}s")
    ).withWatermark(f"{name}t", "2 seconds")
    got = run(spark, folder, bounded_join(side("a"), side("b"), [("ak", "bk")], "inner", "at", "bt", 5.0))
    assert rows_of(got, "ak", "bs") == [(1, 5), (2, 6), (3, 4_000_000_000)]
    stores = glob.glob(f"{folder}/out*-check/state/0/[0-9]*/*")
    assert any(f.endswith(".changelog") for f in stores)
    assert not any(f.rsplit("/", 1)[-1].startswith(("left-", "right-")) for f in stores)


def test_texts_of_the_order_topic_are_built_once(spark, folder, monkeypatch):
    from registry import Tables, order_streams

    class Seen(Exception):
        pass

    def replay(t, name, rows, *_):
        raise Seen(rows)

    monkeypatch.setattr(order_streams, "in_time", replay)
    orders = "id AS o_orderkey, id AS o_custkey, 'O' AS o_orderstatus, timestamp_ntz'1996-01-01' AS o_orderdate"
    lines = "id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 2.0D AS l_quantity, 3.0D AS l_extendedprice, 0.1D AS l_discount, 0.1D AS l_tax, 'R' AS l_returnflag, 'F' AS l_linestatus, timestamp_ntz'1996-01-01' AS l_shipdate"
    spark.range(3).selectExpr(*orders.split(", ")).write.parquet(f"{folder}/orders.parquet")
    spark.range(3).selectExpr(*lines.split(", ")).write.parquet(f"{folder}/lineitem.parquet")
    with pytest.raises(Seen) as seen:
        order_streams.order_topic(Tables(spark, folder))
    rows = seen.value.args[0]
    assert rows.count() == 18 and all("order-topic-texts" in f for f in rows.inputFiles())


def test_visitor_repair_and_channel_window(spark, folder):
    """The log layer as separate streams, each reading what the one before wrote."""
    table, stream = both(spark, folder, LOGS)
    cols = ["mid", "is_new", "page_id", "ts"]
    flat = lambda df: df.select("common.mid", "common.is_new", "page.page_id", "ts").filter("mid <> 'end'")
    pages = traffic.split_raw_logs(table)["page"]
    got = run(spark, folder, traffic.split_raw_logs(stream)["page"])
    assert rows_of(flat(got), *cols) == rows_of(flat(pages), *cols)
    assert ("m1", "0", "home", T0 * 1000 + 9 * DAY) in rows_of(flat(pages), *cols)

    logs = parse_logs(table)
    jobs = [traffic.unique_visitors, traffic.bounce_detail]
    details = [job(logs) for job in jobs]
    days = lambda df: df.select("common.mid", F.to_date(F.timestamp_millis("ts")).alias("day")).filter("mid <> 'end'")
    for job, want, seen, names in zip(jobs, details, (days, flat), (["mid", "day"], cols)):
        _, again = both(spark, folder, LOGS)
        assert rows_of(seen(run(spark, folder, job(parse_logs(again)))), *names) == rows_of(seen(want), *names)

    def windows(page, uv, uj):
        return traffic.channel_window(page, uv, uj, version=False)

    want = windows(logs, *details).filter("stt < '2026'")
    _, again = both(spark, folder, LOGS)
    parsed = parse_logs(again)
    source = lambda df: _as_stream(spark, folder, df)
    got = run(spark, folder, windows(parsed, *(source(d) for d in details))).filter("stt < '2026'")
    assert rows_of(got) == rows_of(want)


def _as_stream(spark, folder, df):
    path = f"{folder}/detail{next(_serial)}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_register_and_cart_windows(spark, folder, dictionary):
    user = lambda i, time, ts: change("user_info", "insert", ts, {"id": i, "create_time": time})
    cart = lambda i, time, ts, **kw: change(
        "cart_info", kw.pop("kind", "insert"), ts, {"id": i, "user_id": kw.pop("user"), "sku_num": "3", "source_type": "2401", "create_time": time, **kw.pop("data", {})}, kw.pop("old", None)
    )
    batches = [
        [user("1", "2024-01-01 00:00:01", T0 + 1), user("2", "2024-01-01 00:00:03", T0 + 3), cart("k1", "2024-01-01 00:00:01", T0 + 1, user="u")],
        [cart("k2", "2024-01-01 00:00:02", T0 + 2, user="u"),
         cart("k1", "2024-01-01 00:00:01", T0 + DAY // 1000, user="u", kind="update", data={"operate_time": "2024-01-02 00:00:00"}, old={"sku_num": "1"})],
        [user("end", "2090-01-01 00:00:00", FAR), cart("end", "2090-01-01 00:00:00", FAR, user="end")],
    ]
    table, stream = both(spark, folder, batches)
    jobs = [
        lambda c: tools.register_window(tools.user_register(c), version=False),
        lambda c: trade.cart_add_window(trade.cart_add(c, dictionary), version=False),
    ]
    for job in jobs:
        want = rows_of(closed(job(parse_changes(table))))
        assert rows_of(closed(run(spark, folder, job(parse_changes(stream))))) == want
    assert [r[2] for r in want] == [1, 1]


def test_payment_detail_and_window(spark, folder, dictionary):
    pay = lambda order, ts, when, status="1602": change(
        "payment_info", "update", ts, {"order_id": order, "payment_type": "1101", "callback_time": when, "payment_status": status}, {"payment_status": "1601"}
    )
    lines = DETAIL.replace(", n int", "")
    full = lambda r: r[:11]
    extra = "sku_name string, activity_id string, activity_rule_id string, coupon_id string, source_id string, source_type_code string, source_type_name string, sku_num string"
    t10 = T0 + 36_000
    pays = [[pay("o1", t10 + 60, "2024-01-01 10:01:00"), pay("o2", t10 + 2_000, "2024-01-01 10:33:20"), pay("o3", t10 + 70, "x", "1601")], [pay("end", FAR, "2096-10-02 07:06:40")]]
    table, stream = both(spark, folder, pays)
    rows = [tuple(full(r)) + (None,) * 8 for b in DETAILS for r in b]
    details = spark.createDataFrame(rows, f"{lines}, {extra}")
    far = details.filter("id = 'end'").withColumn("create_time", F.lit("2096-10-02 07:06:40"))
    details = details.filter("id <> 'end'").union(far)
    want = trade.payment_detail(parse_changes(table), details, dictionary, horizon=905.0)
    detail_stream = _as_stream(spark, folder, details)
    got = run(spark, folder, trade.payment_detail(parse_changes(stream), detail_stream, dictionary))
    cols = ["order_detail_id", "payment_type_name", "callback_time", "split_payment_amount"]
    known = lambda df: rows_of(df.filter("order_detail_id <> 'end'"), *cols)
    assert known(got) == known(want)
    # The line stands twice in the detail table and is paid once for each; the late payment of o2 is out of reach.
    assert {r[0] for r in known(want)} == {"d1", "d2"}
    summary = trade.payment_window(want, version=False).filter("stt < '2090'").collect()
    assert [(r.payment_suc_unique_user_count, r.payment_suc_new_user_count) for r in summary] == [(1, 1)]


def test_offset_settles_versions_of_equal_time(spark, folder, dictionary):
    """The place in the topic is carried through the joins and decides between versions of one time."""
    numbered = [[(v, 10 * b + i) for i, v in enumerate(batch)] for b, batch in enumerate(ORDERS)]
    schema = "value string, offset long"
    table = spark.createDataFrame([r for b in numbered for r in b], schema)
    pre = trade.order_pre_process(parse_changes(table, keep=("offset",)), dictionary, "shop", offset="offset")
    want = rows_of(pre.filter("id <> 'end'"), "id", "type", "offset")
    assert want == [("d1", "insert", 3), ("d1", "update", 11), ("d2", "insert", 10), ("d2", "update", 11)]
    stream = stream_of(spark, folder, numbered, schema)
    got = run(spark, folder, trade.order_pre_process(parse_changes(stream, keep=("offset",)), dictionary, "shop", offset="offset").drop("old"))
    assert rows_of(got.filter("id <> 'end'"), "id", "type", "offset") == want
    assert "offset" in trade.order_detail(pre, ("offset",)).columns


def test_channel_window_waits_for_the_slowest_stream(spark, folder):
    """Bounces that come batches after their pages still count; a row older than its own stream allows is counted as late."""
    page = lambda ms, last=None: (("m", "c", "v", "a", "0"), ("home", last, 1), T0 * 1000 + ms)
    schema = "common struct<mid string, ch string, vc string, ar string, is_new string>, page struct<page_id string, last_page_id string, during_time long>, ts long"
    far = (("end",) * 5, ("end", None, 0), FAR * 1000)
    pages = [[page(0), page(1_000, "x")], [page(60_000)], [page(120_000)], [far]]
    stream = lambda batches: stream_of(spark, folder, batches, schema)
    out = traffic.channel_window(stream(pages), stream([[page(60_000)], [far]]), stream([[page(0)], [page(60_000)], [far]]), version=False)
    path = f"{folder}/channel"
    late = drain(to_files(out, path, f"{path}-check").outputMode("append"))
    got = {r.stt: (r.pv_ct, r.uv_ct, r.uj_ct) for r in spark.read.parquet(path).collect() if r.vc == "v"}
    assert late == 0 and got == {"2024-01-01 00:00:00": (2, 0, 1), "2024-01-01 00:01:00": (1, 1, 1), "2024-01-01 00:02:00": (1, 0, 0)}

    # Lateness is judged by the watermark of the batch before.
    lone = stream([[page(0)], [page(900_000)], [page(900_001)], [page(1)], [far]]).withColumn("rt", F.timestamp_millis("ts")).withWatermark("rt", "2 seconds")
    late = drain(to_files(tumble(lone, "rt", "10 seconds", {"n": F.count("*")}, version=False), f"{folder}/lone", f"{folder}/lone-check").outputMode("append"))
    assert late == 1
