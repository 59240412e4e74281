"""Mixing, packing, archives, links, and the pipeline as a whole."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_operators import ROWS, exact_truth, linked_components, measured, near_copies, prose
from tidemart.llm import archive, links, mixing, packing, session
from tidemart.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


# ---- mixing


def mixed_rows(n=400):
    rows = []
    for i in range(n):
        text = prose(10 + i % 7, i) + (" a@b" if i % 5 == 0 else " licence icense" if i % 7 == 0 else "")
        rows.append((i, text, None if i % 11 == 0 else ("en", "fr", "de")[i % 3], f"src{(i * i) % 4}", len(text)))
    return rows


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"source": {"src0": 3.0, "src1": 1.0}, "lang": 0.5}])
def test_margins_reach_their_targets(docs, targets):
    rows = mixing.calibrated(docs(mixed_rows()), targets).select("row.source", "row.lang", "topic", "n_tokens", "probability").toPandas()
    rows["lang"] = rows["lang"].fillna("none")
    assert rows.probability.max() == pytest.approx(1) and rows.probability.min() >= 0
    rows["expected"] = rows.n_tokens * rows.probability
    for margin, target in targets.items():
        got = rows.groupby(margin).expected.sum()
        if isinstance(target, dict):
            want = got.index.map(lambda k: target.get(k, 0.0)).to_numpy()
        else:
            share = rows.groupby(margin).n_tokens.sum()
            want = (share / share.sum()).to_numpy() ** target
        assert np.allclose(got / got.sum(), want / want.sum(), atol=1e-6), margin


def test_sampling_is_stable_and_calibrated(docs):
    frame = docs(mixed_rows())
    one = {(r.row.doc_id, r.sampled, round(r.probability, 9)) for r in mixing.calibrated(frame).collect()}
    assert one == {(r.row.doc_id, r.sampled, round(r.probability, 9)) for r in mixing.calibrated(frame.repartition(7)).collect()}
    expected, taken = sum(p for _, _, p in one), sum(s for _, s, _ in one)
    assert abs(expected - taken) < 4 * len(one) ** 0.5
    out = mixing.sampled_rows(frame)
    assert out.columns == frame.columns and out.count() == taken


def test_a_stray_category_leaves_the_rate_of_the_others(spark, docs, folder):
    rows = mixed_rows()
    step = dict(corpus_pipeline.STAGES)["source_mixing"]
    stray = (9999, prose(15, 77), "xx", "stray", 100)
    plain, strayed = docs(rows), docs([*rows, stray])
    one, two = ({r.doc_id for r in step(spark, f, folder).collect()} for f in (plain, strayed))
    assert len(one) > 150 and len(one ^ (two - {9999})) < 20
    got = mixing.calibrated(strayed, keep=0.5).select("row.doc_id", "row.source", "n_tokens", "probability").toPandas()
    assert got.probability.between(0, 1).all() and got.probability[got.doc_id == 9999].item() == pytest.approx(1, abs=0.02)
    assert (got.n_tokens * got.probability).sum() == pytest.approx(0.5 * got.n_tokens.sum(), rel=1e-3)


def test_bounded_raking_reaches_budgets(docs):
    rows = mixed_rows()
    targets = {"source": {"src0": 3.0, "src1": 1.0}, "lang": 0.9}
    got = mixing.calibrated(docs(rows), targets, keep=0.4).select("row.source", "row.lang", "n_tokens", "probability").toPandas()
    assert got.probability.between(0, 1).all()
    held = (got.n_tokens * got.probability).groupby(got.source).sum() / got.n_tokens.sum()
    assert held.sum() == pytest.approx(0.4, abs=1e-5) and held["src0"] == pytest.approx(0.3, abs=1e-5)


def test_mixing_odd_tables(docs):
    odd = docs([*ROWS, (99, None, None, None, None)])
    assert mixing.calibrated(odd).count() == len(ROWS) + 1
    assert mixing.calibrated(odd.filter("doc_id < 0")).count() == 0
    blank = mixing.calibrated(odd.filter("doc_id in (6, 7)")).collect()
    assert len(blank) == 2 and all(r.n_tokens == 0 for r in blank)


# ---- packing


def test_pieces_are_powers_of_two_and_cover():
    for n in (1, 2, 3, 4095, 4096, 4097, 12289, 70000):
        cut = packing.pieces(n)
        assert sum(cut) == n and all(x & (x - 1) == 0 and x <= 4096 for x in cut) and cut == sorted(cut, reverse=True)


def test_packing_round_trip(docs):
    rows = [*ROWS, (30, "It's 12% <|endoftext|>don't ﬁ Å ΑΣ Σ\x0b\x0c\x85 x́ é"), (31, "'s's ok\x1cyes")]
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(docs(rows), PATH).collect()
    by_doc = defaultdict(Counter)
    for r in got:
        by_doc[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        assert r.offset == 0
    assert len({r.sequence_id for r in got}) == len(got)
    want = defaultdict(Counter)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for n in packing.pieces(len(ids)):
            want[i][at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
    assert by_doc == want


def test_random_strings_like_the_tokenizer():
    """Letters of all scripts, marks and cases, the dotted capital I among them, in words and between marks."""
    rng = random.Random(11)
    tokenizer, known = Tokenizer.from_file(PATH), packing.Words(PATH)
    letters = [c for c in map(chr, range(33, 0x3000)) if c.isalpha() or not c.isspace()]
    near = "aIiİıÀéßŁǅǆK.,;!?'\"()[]<>|-_0189 日中кЖاあ\u0307\u0301"
    drawn = ("".join(rng.choice(near if rng.random() < 0.7 else letters) for _ in range(rng.randint(1, 8))) for _ in range(60_000))
    for text in ('日İ"', "Iİ.", "İİ!", *drawn):
        ids = np.frombuffer(packing.encode(text.encode(), known), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_forgetting_words_changes_nothing(monkeypatch):
    known = packing._words.__wrapped__(PATH)
    texts = [(prose(30, i) + " a b c").encode() for i in range(20)]
    want = [packing.encode(t, known) for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    few = packing._words.__wrapped__(PATH)
    assert [packing.encode(t, few) for t in texts] == want and len(few) <= 5


def test_packing_empty_table(docs):
    assert packing.pack(docs([(1, "x")]).filter("doc_id < 0"), PATH).count() == 0


# ---- archives


PAGES = [
    (3, "http://a.example/x", "<p>é</p>" * 30),
    (1, "http://b.example/x y\n", "<p>é</p>" * 30),
    (2, None, "<p>é</p>" * 30),
    (2, "http://c.example/", "<p>é</p>" * 30),
    (None, "http://d.example/", "<p>é</p>" * 30),
    (4, "http://e.example/", "short"),
    (5, "http://e.example/", "short"),
    (6, "", None),
    (7, "http://f.example/", ""),
    (8, "http://g.example/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
    (9, "http://h.example/", "filedesc://x 0 0 text/plain 5\n" * 20),
    (10, "http://i.example/", "y" * 3_000_000),
    (11, "http://j.example/", "y" * 3_000_000),
]


def pages_table(spark, folder, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    frame.repartition(3).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_archives_round_trip(spark, folder):
    got = QUERIES["op8_arc_to_warc"](spark, pages_table(spark, folder, PAGES)).collect()
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in PAGES
    )
    for html, ids in groups.items():
        mine = [r for r in got if r.payload_digest == hashlib.sha256(html.encode()).hexdigest()]
        if len(html.encode()) < 100:
            assert all(r.record_type == "response" and r.refers_to is None for r in mine)
        else:
            first = min(i for i in ids if i is not None)
            assert [r.page_id for r in mine if r.record_type == "response"] == [first]
            assert all(r.refers_to == first for r in mine if r.record_type == "revisit")


def test_both_arc_versions_are_parsed_by_their_fields():
    for version in (1, 2):
        block = archive._version_block("n.arc", version)
        record = archive.arc_record("n.arc", version, len(block) + 1, 5, "http://a b", b"body")
        (r,) = archive.parse_arc(block + b"\n" + record + b"\n")
        assert r["header"]["URL"] == "http://a%20b" and r["block"].endswith(b"\r\n\r\nbody") and r["offset"] == len(block) + 1
        assert r["archive"] == "n.arc" and r["header"]["Archive-date"] == archive.FETCHED
    with pytest.raises(ValueError, match="header fields"):
        list(archive.parse_arc(archive._version_block("n.arc", 2) + b"\n" + archive.arc_record("n.arc", 1, 0, 5, "u", b"x")))
    with pytest.raises(ValueError, match="declares"):
        list(archive.parse_arc(archive._version_block("n.arc", 1) + b"\n" + archive.arc_record("n.arc", 1, 0, 5, "u", b"x" * 50)[:-9]))


def test_no_pages(spark, folder):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    frame.write.parquet(f"{folder}/pages.parquet")
    assert QUERIES["op8_arc_to_warc"](spark, folder).count() == 0
    assert QUERIES["op9_link_trust"](spark, folder).count() == 0


# ---- links


def judged(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    return {r.page_id: r for r in links.judge(frame).collect()}


def test_rules_and_parts_of_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?y#z", None),
        (2, "http://m.example.com/en/", None),
        (3, "http://example.com", None),
        (4, "http://x.net/es/a/b", None),
        (5, "http://notexample.com/en/", None),
        (6, "http://example.com?q=/en/", None),
        (7, None, "x"),
        (8, "no scheme", "x"),
        (9, "", ""),
        (10, "http://net/fr/#/es/", None),
        (10, "http://net/fr/#/es/", None),
    ]
    got = judged(spark, rows)
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("m.example.com", "/en/", "example.com/en/", "block"),
        3: ("example.com", "", None, "allow"),
        4: ("x.net", "/es/a/b", "net/es/", "block"),
        5: ("notexample.com", "/en/", "com/", "allow"),
        6: ("example.com", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("net", "/fr/", "net/fr/", "block"),
    }


def test_distrust_flows_back_and_trust_forward(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/p">' for h in hosts)
    rows = [
        (1, "http://bad.net/es/", link("farm.org")),
        (2, "http://bad.net/fr/", ""),
        (3, "http://farm.org/", link("bad.net", "bad.net", "FARM.org")),
        (4, "http://good.com/", link("friend.org")),
        (5, "http://friend.org/", ""),
        (6, "http://bad.net/other", None),
        (7, "http://alone.org/", "<a href='/local'>"),
    ]
    got = judged(spark, rows)
    assert [got[i].verdict for i in (3, 5, 6, 7)] == ["block", "allow", "block", "allow"]
    # Scores by hand: 2 of 3 pages of bad.net are refused; farm.org and bad.net hand all they have to each other.
    seed, d = 0.15 * 2 / 3, 0.85
    assert got[6].distrust == pytest.approx(seed / (1 - d * d), abs=1e-3)
    assert got[3].distrust == pytest.approx(d * seed / (1 - d * d), abs=1e-3)
    assert got[5].trust == pytest.approx(0.15 * d, abs=1e-5)


# ---- pipeline


def test_pipeline_against_brute_force(spark, docs, folder):
    rows = [*ROWS, *near_copies(12, 81), *near_copies(5, 82)]
    frame = docs(rows)
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["quality_rules"](spark, frame, folder)
    bad = lambda t: (lambda n, chars, sym, dup, rep: n < 20 or 100 * rep > 30 * n or 10 * sym > n or chars > 15 * n or 10 * (t or "").count("!") > 3 * n)(*measured(t))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in rows if not bad(t))
    exact = corpus_pipeline.stored(steps["exact_dedup"](spark, corpus_pipeline.stored(clean, "a"), folder), "b")
    left = [(r.doc_id, r.text) for r in exact.collect()]
    assert len(left) == len({t.lower() for _, t in left}) and len({t for t in exact_truth()}) > 0
    near = corpus_pipeline.stored(steps["near_dedup"](spark, exact, folder), "c")
    assert near.columns == frame.columns
    assert {r.doc_id for r in near.collect()} == {c for _, _, c in linked_components(left, 5, 80)}
    mixed = corpus_pipeline.stored(steps["source_mixing"](spark, near, folder), "d")
    assert mixed.columns == frame.columns and mixed.count() <= near.count()
    packed = steps["sequence_packing"](spark, mixed, folder)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in totals)


def test_pipeline_takes_an_empty_table(spark, docs, folder):
    frame = docs([(1, "x")]).filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(stage(spark, frame, folder), name)
    assert frame.count() == 0


def test_pipeline_leaves_no_folder_but_its_result(spark, docs, folder):
    """The table by that name in a folder of its own; what a stage kept between its jobs goes once its result is stored."""
    docs([*ROWS, *near_copies(8, 83)])
    home = next(os.path.dirname(os.path.join(d, n)) for d, names, _ in os.walk(folder) for n in names if n == "documents.parquet")
    root = os.path.dirname(session.work_dir(spark, "x")).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, home)
    left = set(os.listdir(root)) - before
    assert {n.rsplit("-", 1)[0] for n in left} == {"pipeline-sequence_packing"} and len(left) == 1
    assert out.count() == out.filter("length > 0").count() > 0


def test_stages_called_alone_drop_what_earlier_ones_left(spark, docs, folder):
    frame = docs([*ROWS, *near_copies(8, 84)])
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["quality_rules"](spark, frame, folder)
    exact_rows = steps["exact_dedup"](spark, session.stored(clean, "a"), folder)
    made = [f for kept in corpus_pipeline._left.values() for f in kept]
    assert made and all(os.path.isdir(f.removeprefix("file://")) for f in made)
    kept = session.stored(exact_rows, "c")
    path = next(iter({f.rsplit("/", 1)[0] for f in kept.inputFiles()})).replace("file:///", "/")
    assert session.drop_folders(spark, [path], still_read=kept) == [path] and kept.count() > 0
    steps["near_dedup"](spark, kept, folder)
    assert not any(os.path.isdir(f.removeprefix("file://")) for f in made)
