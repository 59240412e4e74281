"""Hard negatives against scores of all pairs, and how much of the tree a search leaves out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int, seq string, leaf int, id string"


@pytest.fixture
def vectors(spark, folder):
    def make(rows, files=3):
        path = f"{folder}/embeddings.parquet"
        spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(files).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


def truth(rows, reach=80):
    taking = [
        (i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (anchor, label, v) in enumerate(taking):
        if anchor is None or anchor % 100:
            continue
        scores = sorted(((-dot(v, w), last(i), i, other == label) for j, (i, other, w) in enumerate(taking) if j != k), key=lambda r: r[:2])
        for p, _, positive, _ in [s for s in scores if s[3]][:5]:
            fit = [s for s in scores if not s[3] and reach * -p <= -100 * s[0] <= 100 * -p]
            out += [(anchor, positive, rank, i, -p, -s) for rank, (s, _, i, _) in enumerate(fit[:5], 1)]
    return sorted(out, key=str)


def clustered(n=900, size=6, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, size))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 12] / 3 + rng.normal(size=size) / 20], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(300)]
    rows += [(None, rows[3][1], 1), (200, rows[5][1], 2), (200, rows[5][1], 2), (1500, [0.0] * size, 1), (1600, [-x for x in rows[0][1]], 0)]
    rows += [(1700, None, 1), (1800, rows[0][1], None), (1900, [float("nan")] * size, 1), (2000, [float("inf")] * size, 1), (2100, [None] * size, 0)]
    return rows + [(2200, rows[1][1][:3], 1), (2300, [], 1)]


def mined(frame):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = gnat.build(frame, label=moved)
    return index, sorted((tuple(r) for r in gnat.mine(index, F.col("id") % 100 == 0).collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"LEAF_ROWS": 40, "WAYS": 4, "SAMPLE": 400}, {"LEAF_ROWS": 100, "BLOCK_BYTES": 8 * 6 * 9, "CELLS": 1024 * 2}])
def test_against_all_pairs(vectors, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(gnat, name, value)
    rows = clustered() if not limits else clustered(600, seed=2)
    index, got = mined(vectors(rows))
    assert got == truth(rows)
    assert not limits or len(index.leaves) > 4


def test_large_components_in_whole_numbers(vectors):
    rng = random.Random(4)
    rows = [(i * 20, [float(np.float32(rng.uniform(-3e5, 3e5))) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(vectors(rows))[1] == truth(rows)


def test_sums_that_do_not_fit_fail(vectors):
    with pytest.raises(OverflowError):
        mined(vectors([(i, [1e10, 1.0], 1) for i in range(3)]))


def test_empty_and_lonely(vectors):
    assert mined(vectors([]))[1] == []
    assert mined(vectors([(1, [0.1], 1), (2, [0.2], 1)]))[1] == []
    assert mined(vectors([(100, [0.1], 1), (2, None, 1)]))[1] == []


def test_tree_leaves_most_of_a_clustered_space_out(vectors, monkeypatch):
    monkeypatch.setattr(gnat, "LEAF_ROWS", 40)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(25, 8))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 25] / 2 + rng.normal(size=8) / 100], i % 5) for i in range(2000)]
    index = gnat.build(vectors(rows))
    anchors = next(gnat.anchor_blocks(index, F.col("id") % 100 == 0))
    reach = gnat._Reach(index, anchors)
    own = (anchors.vectors * anchors.vectors).sum(1)
    far = reach.radius((0.95 * own)[:, None])
    kept = [reach.inside(leaf, np.zeros_like(far), far).sum() for leaf in range(len(index.leaves))]
    assert len(index.leaves) > 20 and sum(kept) < 0.4 * len(anchors.seq) * len(index.leaves)
