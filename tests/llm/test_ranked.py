"""Search over max-sketches against scores worked out for every pair of item and document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemart.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def truth(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, size in counted:
            m = 75 + 25 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if gone else doc, -s) for rank, (s, gone, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def words(rng, n, spread=400):
    return " ".join(f"W{int(rng.paretovariate(0.7)) % spread}" + rng.choice(["", ".", "é", "İ", "_x"]) for _ in range(n))


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    docs = [(i, words(rng, rng.choice([0, 1, 3, 40, 400]))) for i in range(n)]
    docs += [(n, words(rng, 30_000, 9000)), (n + 1, None), (n + 2, ""), (n + 3, " .,\n"), (None, docs[4][1]), (7, docs[4][1])]
    docs += [(n + 10 + i, "W1 W2 copied text W3é") for i in range(60)]
    items = [(i, words(rng, rng.choice([1, 5, 50]))) for i in range(25)]
    return docs, items + [(25, "w1 W1 copied"), (25, "w1 W1 copied"), (26, None), (27, "?!"), (None, "copied w3É"), (28, "unknownterm")]


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash", 3) for r in rows], "item_id long, text string, term string, score int")


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"BLOCK_TERMS": 40, "CELLS": 2000, "PROBES": 1, "HELD_TERMS": 8}])
def test_search_against_all_pairs(docs, items, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    rows, asked = corpus()
    if limits:
        rows, asked = rows[:80] + rows[300:], asked[::4]
    assert found(ranked.search(ranked.build(docs(rows)), items(asked))) == truth(rows, asked)


def test_one_index_many_searches(docs, items):
    rows, asked = corpus(6, 100)
    index = ranked.build(docs(rows))
    assert found(ranked.search(index, items(asked[:3]), top=5)) == truth(rows, asked[:3], 5)
    assert found(ranked.search(index, items(asked[3:6]), top=1)) == truth(rows, asked[3:6], 1)


def test_empty_tables(docs, items):
    assert ranked.search(ranked.build(docs([])), items([(1, "a b")])).count() == 0
    assert ranked.search(ranked.build(docs([(1, None)])), items([(1, "a b")])).count() == 0
    assert ranked.search(ranked.build(docs([(1, "a")])), items([])).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_scores():
    rng = random.Random(3)
    texts = pa.array([words(rng, n) for n in (1, 5, 50, 500, 5000)] + [None])
    size = ranked.Corpus(5, 5556)
    sketches = ranked._sketched(texts, size)
    asked = [t.encode() for t in {t for t in terms(texts[3].as_py())}] + [b"absent"]
    block = ranked.Block([0], asked, [np.arange(len(asked))], [np.arange(1, len(asked) + 1)])
    exact = ranked._exact(texts, block, pa.array(asked, pa.large_binary()), size) @ block.weights[0]
    bound = ranked._bounds(sketches.slice(0, 5), ranked._cells(asked), block)[0]
    assert (bound >= exact[:5]).all() and exact[5] == 0
    assert bound[3] <= 1.06 * exact[3] + 1


def test_most_documents_are_not_scored(docs, items, spark, folder):
    """One long item, a third of the documents alike, few good ones: sketches must spare most texts."""
    rng = random.Random(8)
    rows = [(i, words(rng, 40) if i % 3 else "W1 W2 W3 copy") for i in range(600)]
    rows += [(1000 + i, "needle haystack pin " + words(rng, 30)) for i in range(25)]
    index = ranked.build(docs(rows, files=1))
    block = next(ranked.blocks(items([(0, "needle haystack pin w1")]), index))
    least = ranked._thresholds(index, block, 20)
    above = 0
    for part in index.rows.select("sketch").toArrow().to_batches():
        above += int((ranked._bounds(part["sketch"], ranked._cells(block.terms), block)[0] >= least[0]).sum())
    assert 20 <= above <= 40
