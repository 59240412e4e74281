"""Hard negatives found with a multiway hyperplane tree over all vectors.

An inner product falls as a distance grows once all vectors have one length: each gets one more coordinate that lifts
it to the length of the longest, and an anchor gets none. So "score between a and b" is an annulus around the anchor.

The tree is fitted on a bounded sample (`SAMPLE` rows by hash). A node has up to `WAYS` split points, chosen far from
each other, and every vector belongs to the nearest of them. All vectors are sent down the tree and stored in order of
their leaf, and for each node the least and largest distance from every split point to the vectors below every sibling
is taken over all of them. A subtree is out of the question for an annulus if for some split point the distances that
the triangle inequality leaves between it and the anchor miss that range. What remains is compared exactly in the
leaves, in whole numbers.

Anchors are searched in blocks of `BLOCK_BYTES`. A block is sent to the tasks, which read their part of the stored
vectors once per round: positives in the anchors' own leaves, positives in all leaves that the fifth best leaves over,
then negatives in the same two rounds. Work is thus split by stored rows, whatever leaf or label they belong to: a
leaf that holds a third of all vectors, as copies would, spans many partitions.

Rows with a null label, a null vector, or a null or non-finite component take no part. Null ids rank behind all others
of equal score and are no anchors; rows that repeat an id count each. Vectors shorter than the longest count as having
zeros behind. Products beyond 2^63 fail the query rather than wrap. A table without anchors, positives or
negatives gives no rows. Columns beyond id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemart.llm.session import prepared, stored, table

#: Vectors the tree is fitted on, split points per node, and vectors per leaf that fitting aims at.
SAMPLE, WAYS, LEAF_ROWS, DEPTH = 16_384, 12, 1024, 6
#: Bytes of vectors in one block of anchors.
BLOCK_BYTES = 16 << 20
#: Anchors times vectors compared at once.
CELLS = 1 << 21
POSITIVES = NEGATIVES = 5
#: Share of the positive's score a negative must reach, in hundredths.
REACH = 80


class Node(NamedTuple):
    """Split points (lifted), the node or leaf (as -1 - leaf) under each, and this node's parent and way there."""

    points: np.ndarray
    children: list[int]
    parent: int
    way: int


class Index(NamedTuple):
    rows: DataFrame  # seq, id, label, vector, leaf
    nodes: list[Node]
    ranges: dict[int, np.ndarray]  # node -> (points, children, 2): least and largest distance
    leaves: list[tuple[int, int]]  # node and way of each leaf
    top: int  # squared length of the longest vector
    size: int  # components
    largest: int  # absolute component


class Anchors(NamedTuple):
    """A block of anchors: row numbers, ids, labels, vectors, and the leaf each lies in."""

    seq: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    leaf: np.ndarray


# ---- numbers


def _dense(column: pa.Array, size: int) -> np.ndarray:
    """List column as a matrix, zeros behind short vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """Inner products in whole numbers; as doubles only where none of their sums can round."""
    bound = a.shape[1] * largest * largest
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    raise OverflowError("inner products of these vectors do not fit 64 bits")


def _lifted(vectors: np.ndarray, top: int) -> np.ndarray:
    wide = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(top - (wide * wide).sum(1), 0))
    return np.concatenate([wide, rest[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


# ---- fitting


def _spread(points: np.ndarray, ways: int, rng: np.random.Generator) -> np.ndarray:
    """Split points: each the candidate farthest from those before it."""
    found = points[rng.choice(len(points), min(len(points), 3 * ways), replace=False)]
    chosen = [0]
    gap = _distances(found[:1], found)[0]
    while len(chosen) < ways and gap.max() > 1e-6 * (1 + np.abs(found).max()):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(found[chosen[-1]][None], found)[0])
    return found[chosen]


def _fit(points: np.ndarray, per_leaf: float) -> tuple[list[Node], list[tuple[int, int]]]:
    """Nodes from a sample; a part is split on while it is expected to hold more than a leaf's rows."""
    rng, nodes, leaves = np.random.default_rng(0), [], []

    def grow(part: np.ndarray, parent: int, way: int, depth: int) -> int:
        splits = _spread(part, WAYS, rng) if len(part) > max(per_leaf, 2 * WAYS) and depth < DEPTH else part[:0]
        if len(splits) < 2:
            leaves.append((parent, way))
            return -len(leaves)
        here, nearest = len(nodes), _distances(part, splits).argmin(1)
        nodes.append(Node(splits, [], parent, way))
        for k in range(len(splits)):
            nodes[here].children.append(grow(part[nearest == k], here, k, depth + 1))
        return here

    if len(points):
        grow(points, -1, 0, 0)
    return nodes, leaves or [(-1, 0)]


def _descend(lifted: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """The leaf of each vector."""
    leaf = np.zeros(len(lifted), np.int64)
    waiting = [(0, np.arange(len(lifted)))] if nodes else []
    while waiting:
        at, rows = waiting.pop()
        nearest = _distances(lifted[rows], nodes[at].points).argmin(1)
        for k, child in enumerate(nodes[at].children):
            below = rows[nearest == k]
            if not len(below):
                continue
            if child < 0:
                leaf[below] = -1 - child
            else:
                waiting.append((child, below))
    return leaf


def _path(leaf: int, nodes: list[Node], leaves: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, way taken) from a leaf up to the root."""
    found, (at, way) = [], leaves[leaf]
    while at >= 0:
        found.append((at, way))
        at, way = nodes[at].parent, nodes[at].way
    return found


def _runs(leaf: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal leaf."""
    edges = np.flatnonzero(np.diff(leaf)) + 1
    for a, b in zip([0, *edges], [*edges, len(leaf)]):
        if b > a:
            yield int(leaf[a]), slice(a, b)


# ---- index


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("bigint"))


def build(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> Index:
    """The stored index over all rows that take part."""
    prepared(rows.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    taking = rows.filter(F.col(vector).isNotNull() & label.isNotNull() & finite).select(
        F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), whole_numbers(F.col(vector)).alias("vector")
    )
    # Drawn once, in the write; see `session.numbered`.
    plain = stored(taking.withColumn("seq", F.monotonically_increasing_id()), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    seen = plain.agg(
        F.count("*").alias("n"), F.max(squares).alias("top"), F.max(F.size("vector")).alias("size"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")
    ).first()
    size, largest = max(seen.size or 0, 1), int(seen.largest or 0)
    if size * largest * largest >= 1 << 63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    top = int(seen.top or 0)
    sample = plain.orderBy(F.xxhash64("seq", "id")).limit(SAMPLE).select("vector").toArrow()["vector"]
    points = _lifted(_dense(sample, size), top)
    nodes, leaves = _fit(points, LEAF_ROWS * len(points) / max(seen.n, 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = _descend(_lifted(_dense(batch["vector"], size), top), nodes)
            yield pa.record_batch([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest distance of every split point of a node to what a task has seen below each way."""
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lifted, leaf = _lifted(_dense(batch["vector"], size), top), batch["leaf"].to_numpy()
            for one, stretch in _runs(leaf):
                for at, way in _path(one, nodes, leaves):
                    gaps = _distances(lifted[stretch], nodes[at].points)
                    low[at, way] = np.minimum(gaps.min(0), low.get((at, way), np.inf))
                    high[at, way] = np.maximum(gaps.max(0), high.get((at, way), 0.0))
        keys = list(low)
        yield pa.record_batch(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([d[k].tolist() for k in keys], pa.list_(pa.float64())) for d in (low, high))],
            ["node", "way", "low", "high"],
        )

    spread = plain.mapInArrow(placed, "id long, label long, vector array<long>, seq long, leaf long")
    sorted_rows = stored(spread.repartitionByRange("leaf", "seq").sortWithinPartitions("leaf", "seq"), "vector-leaves")
    ranges = {}
    if nodes:
        widest = max(len(n.points) for n in nodes)
        each = sorted_rows.select("vector", "leaf").mapInArrow(spans, "node int, way int, low array<double>, high array<double>")
        ends = [f(F.try_element_at(c, F.lit(i + 1))).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(widest)]
        for node, n in enumerate(nodes):
            # A way without vectors keeps an empty range, which no annulus meets.
            ranges[node] = np.stack([np.full((len(n.points), len(n.children)), np.inf), np.full((len(n.points), len(n.children)), -np.inf)], -1)
        # As many rows as the tree has ways.
        for row in each.groupBy("node", "way").agg(*ends).collect():
            for i in range(len(nodes[row.node].points)):
                ranges[row.node][i, row.way] = row[f"low{i}"], row[f"high{i}"]
    return Index(sorted_rows, nodes, ranges, leaves, top, size, largest)


# ---- search


class _Reach:
    """Which anchors an annulus lets into a leaf; the distances to a node's split points are kept while in use."""

    def __init__(self, index: Index, anchors: Anchors) -> None:
        self.index, self.kept = index, {}
        self.wide = np.concatenate([anchors.vectors.astype(np.float64), np.zeros((len(anchors.vectors), 1))], 1)
        self.squares = (self.wide * self.wide).sum(1)
        # Rounding of distances, in the scale of the vectors.
        self.slack = 1e-6 * (1 + np.sqrt(self.squares + index.top))

    def radius(self, scores: np.ndarray) -> np.ndarray:
        """Distance at which a vector has such a score."""
        return np.sqrt(np.maximum(self.squares[:, None] + self.index.top - 2.0 * scores, 0))

    def inside(self, leaf: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Anchors (rows) for which some window (columns of `near` and `far`) may meet the leaf."""
        path = _path(leaf, self.index.nodes, self.index.leaves)
        self.kept = {at: self.kept[at] for at, _ in path if at in self.kept}
        alive = np.ones(near.shape, bool)
        for at, way in path[::-1]:
            if at not in self.kept:
                self.kept[at] = _distances(self.wide, self.index.nodes[at].points)
            low, high = self.index.ranges[at][:, way].T
            gap = self.kept[at]
            nearest = np.maximum(np.maximum(gap - high, low - gap), 0).max(1) - self.slack
            farthest = (gap + high).min(1) + self.slack
            alive &= (nearest[:, None] <= far) & (farthest[:, None] >= near)
        return alive


_EMPTY = np.zeros((0, 4), np.int64)
_LAST = np.iinfo(np.int64).max


class _Best:
    """The best `size` rows of each slot: by score, then id, nulls (as the last number) behind."""

    def __init__(self, slots: int, size: int, floor: np.ndarray) -> None:
        self.size, self.floor = size, floor.copy()
        # Of rows that only reach the floor, those up to this id may still get a place.
        self.edge = np.full(slots, _LAST, np.int64)
        self.rows = _EMPTY  # slot, -score, id, seq

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, seq: np.ndarray) -> None:
        if not len(slot):
            return
        rows = np.concatenate([self.rows, np.stack([slot, -score, ids, seq], 1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.size]
        last = rows[place == self.size - 1]
        last = last[-last[:, 1] >= self.floor[last[:, 0]]]
        self.floor[last[:, 0]], self.edge[last[:, 0]] = -last[:, 1], last[:, 2]


def _scan(index: Index, anchors: Anchors, size: int, floor: np.ndarray, roof: np.ndarray | None, own: bool) -> Callable:
    """A task's best rows per anchor and window: `floor` and `roof` are the scores (anchors x windows) that bound it.

    Without a roof it looks for rows of the anchor's label, with one for rows of other labels. `own` reads the
    anchors' own leaves only.
    """
    width = floor.shape[1]
    step = max(1, CELLS // 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, best = _Reach(index, anchors), _Best(floor.size, size, floor.reshape(-1))
        near = np.zeros(floor.shape) if roof is None else reach.radius(roof)
        last, allowed = -1, np.zeros(0, np.int64)
        for batch in batches:
            leaf, seqs = batch["leaf"].to_numpy(), batch["seq"].to_numpy()
            ids, labels = batch["id"].fill_null(_LAST).to_numpy(), batch["label"].to_numpy()
            vectors = _dense(batch["vector"], index.size)
            for one, stretch in _runs(leaf):
                if one != last:
                    last = one
                    if own:
                        allowed = np.flatnonzero(anchors.leaf == one)
                    else:
                        far = reach.radius(best.floor.reshape(floor.shape).astype(np.float64))
                        allowed = np.flatnonzero((reach.inside(one, near, far) if index.nodes else np.ones(floor.shape, bool)).any(1))
                for at in range(0, len(allowed), step):
                    some = allowed[at : at + step]
                    scores = _products(anchors.vectors[some], vectors[stretch], index.largest)
                    same = anchors.labels[some][:, None] == labels[stretch][None]
                    if roof is None:
                        fit = same & (anchors.seq[some][:, None] != seqs[stretch][None])
                    else:
                        fit = ~same
                    for w in range(width):
                        slot = some * width + w
                        least, edge = best.floor[slot][:, None], best.edge[slot][:, None]
                        hit = fit & ((scores > least) | ((scores == least) & (ids[stretch][None] <= edge)))
                        if roof is not None:
                            hit &= scores <= roof[some, w][:, None]
                        r, c = np.nonzero(hit)
                        best.add(slot[r], scores[r, c], ids[stretch][c], seqs[stretch][c])
        rows = best.rows
        yield pa.record_batch(
            [pa.array(rows[:, 0]), pa.array(-rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3])], ["slot", "score", "id", "seq"]
        )

    return run


_FOUND = "slot long, score long, id long, seq long"
#: A floor below every score that fits, and a roof that lets nothing in.
_NONE = -(1 << 62)


def _round(index: Index, anchors: Anchors, size: int, floor: np.ndarray, roof: np.ndarray | None, own: bool) -> DataFrame:
    """The best rows of each slot over all tasks, ranked."""
    found = index.rows.mapInArrow(_scan(index._replace(rows=None), anchors, size, floor, roof, own), _FOUND)
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "seq")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _raised(floor: np.ndarray, found: DataFrame, size: int) -> np.ndarray:
    """The floor of each slot whose places are all taken lifted to its last place."""
    out = floor.copy().reshape(-1)
    for row in found.filter(F.col("rank") == size).select("slot", "score").collect():
        out[row.slot] = max(out[row.slot], row.score)
    return out.reshape(floor.shape)


def anchor_blocks(index: Index, is_anchor: Column) -> Iterator[Anchors]:
    """Anchors in blocks of bounded size, in order of their leaf, so that a block's anchors share leaves."""
    most, held = max(1, BLOCK_BYTES // (8 * index.size)), []

    def block() -> Anchors:
        seq, ids, labels, leaf, vectors = zip(*held)
        return Anchors(*(np.array(x, np.int64) for x in (seq, ids, labels)), _dense(pa.array(vectors, pa.list_(pa.int64())), index.size), np.array(leaf, np.int64))

    for row in index.rows.filter(is_anchor).select("seq", "id", "label", "leaf", "vector").toLocalIterator():
        held.append(tuple(row))
        if len(held) == most:
            yield block()
            held = []
    if held:
        yield block()


def mine(index: Index, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, reach: int = REACH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors."""
    spark, passes = index.rows.sparkSession, []
    for anchors in anchor_blocks(index, is_anchor):
        n = len(anchors.seq)
        floor = np.full((n, 1), _NONE, np.int64)
        floor = _raised(floor, _round(index, anchors, positives, floor, None, True), positives)
        pairs = _round(index, anchors, positives, floor, None, False).select("slot", "rank", "score", "id").collect()
        low, high = np.full((n, positives), -_NONE, np.int64), np.full((n, positives), _NONE, np.int64)
        for row in pairs:
            high[row.slot, row.rank - 1] = row.score
            # Whole scores from 80 % on; a negative positive score leaves a window without scores.
            low[row.slot, row.rank - 1] = -((-reach * row.score) // 100)
        tight = _raised(low, _round(index, anchors, negatives, low, high, True), negatives)
        found = _round(index, anchors, negatives, tight, high, False)
        ids = [int(anchors.ids[row.slot]) for row in pairs]
        known = [(row.slot * positives + row.rank - 1, a, None if row.id == _LAST else row.id, row.score) for row, a in zip(pairs, ids)]
        names = spark.createDataFrame(known, "slot long, anchor_id long, positive_id long, positive_score long")
        rows = found.join(F.broadcast(names), "slot").select(
            "anchor_id", "positive_id", "rank", F.when(F.col("id") != _LAST, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        passes.append(stored(rows, "negatives"))
    if not passes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for more in passes[1:]:
        passes[0] = passes[0].unionByName(more)
    return passes[0]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(build(table(spark, sf_dir, "embeddings"), label=moved), F.col("id") % 100 == 0)


SQL11 = """
WITH e AS (
  SELECT row_number() OVER () AS seq, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.seq AS aseq, a.vec_id AS anchor_id, b.seq AS bseq, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.seq <> b.seq),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aseq ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.aseq, p.bseq ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.aseq = s.aseq AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
