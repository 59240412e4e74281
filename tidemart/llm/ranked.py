"""Ranked lexical search over hashed max-sketches of all documents.

A document's impact of a term is what the term would add to a score, but for its weight. The index folds all impacts
of a document into a sketch: `HASHES` rows of cells, a term's cell in each row by a hash, and a cell holds the largest
impact that falls into it, rounded up to one of 255 levels. The least of a term's cells is thus never below its
impact, and the weighted sum over a query's terms never below the score. Sketches have four times as many cells per
row as the document has distinct terms, rounded up to a power of two, so long documents are told apart as well as
short ones.

Building scans the documents twice, once for the lexicon (documents and occurrences of every term) and once for the
sketches. A search takes the items in blocks. Every document's bound for every item comes from its sketch; the
`PROBES` documents with the highest bounds of each item are scored from their texts and give a first threshold; then
every partition of the index scores its own documents in descending order of bounds until the bounds fall below the
larger of that threshold and the score of its own last place. Only a task's best documents of an item leave it. The
result is exact: terms are compared as bytes, hashes only ever loosen a bound.

Null texts and texts without a term match nothing and count nowhere. Null ids rank behind all others of equal score;
rows that repeat an id are documents of their own. Items without a term, and empty tables, give no rows; items that
repeat an id are searched each for itself. A text of any length is read whole, in a batch of its own if need be.
Columns beyond id and text are not read.

`BLOCK_TERMS` bounds what one pass broadcasts; a larger query set takes more passes, never fewer terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemart.llm.session import prepared, stored, table
from tidemart.llm.words import lower_ascii, slices, text_bytes

TOP = 20
HASHES = 2
#: Documents per item that are scored for the first threshold.
PROBES = 64
#: Distinct terms of the items searched in one pass; an item with more is a pass of its own.
BLOCK_TERMS = 8192
#: Entries of a task's table of documents by terms.
CELLS = 1 << 22
#: Terms a task holds before it hands on their counts.
HELD_TERMS = 1 << 18
#: What a frequent term's impact saturates towards.
SCALE = 1_000_000_000

_LEVELS = np.unique(np.concatenate(([0], np.ceil(np.power(1e6, np.arange(256) / 255.0)).astype(np.int64))))
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


class Corpus(NamedTuple):
    """Documents with a term, and occurrences of all terms."""

    documents: int
    terms: int


class Index(NamedTuple):
    rows: DataFrame
    lexicon: DataFrame
    corpus: Corpus


class Block(NamedTuple):
    """Items searched together: their places, ids, and the terms with their weights times repeats."""

    ids: list
    terms: list[bytes]
    places: list[np.ndarray]
    weights: list[np.ndarray]


def terms_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The row and the bytes of every term of the texts, in order, A-Z lower-cased."""
    data, offsets = text_bytes(texts)
    inside = _IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head], last[tail] = inside[head], inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    kept = lower_ascii(data[inside])
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(kept)])
    return np.searchsorted(offsets, starts, "right") - 1, terms


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Terms per text, and (text, place in the dictionary, occurrences) of each distinct term of a text."""
    rows, terms = terms_of(texts)
    lengths = np.bincount(rows, minlength=len(texts))
    coded = terms.dictionary_encode()
    words = coded.dictionary
    pairs, times = np.unique(rows * max(len(words), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return lengths, pairs // max(len(words), 1), pairs % max(len(words), 1), times, words


def _impacts(times: np.ndarray, lengths: np.ndarray, corpus: Corpus) -> np.ndarray:
    norms = 75 + (25 * lengths * corpus.documents) // corpus.terms
    return (SCALE * times) // (1000 * times + 12 * norms)


# ---- lexicon

_COUNTS = pa.schema([("term", pa.binary()), ("documents", pa.int64()), ("occurrences", pa.int64())])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per term of what a task reads, and a row without a term for the corpus as a whole."""
    held, size, documents, total = [], 0, 0, 0

    def summed() -> pa.Table:
        whole = pa.concat_tables(held).group_by("term").aggregate([("documents", "sum"), ("occurrences", "sum")])
        return pa.table([whole["term"], whole["documents_sum"], whole["occurrences_sum"]], schema=_COUNTS)

    for batch in batches:
        for part in slices(batch, "text"):
            lengths, _, codes, times, words = _counted(part["text"])
            documents, total = documents + int((lengths > 0).sum()), total + int(lengths.sum())
            if len(words):
                counts = np.bincount(codes, minlength=len(words)), np.bincount(codes, times, len(words)).astype(np.int64)
                held.append(pa.table([words.cast(pa.binary()), *map(pa.array, counts)], schema=_COUNTS))
                size += len(words)
            if size > 4 * HELD_TERMS:
                held = [summed()]
                size = held[0].num_rows
                if size > HELD_TERMS:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=1 << 16)
                    size = 0
    if held:
        yield from summed().combine_chunks().to_batches(max_chunksize=1 << 16)
    yield pa.record_batch([pa.array([None], pa.binary()), pa.array([documents]), pa.array([total])], schema=_COUNTS)


# ---- sketches


def _cells(words: list[bytes]) -> np.ndarray:
    """`HASHES` independent 32-bit hashes of each word."""
    whole = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return np.stack([whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32)]).astype(np.int64)


def _sketched(texts: pa.Array, corpus: Corpus) -> pa.Array:
    lengths, rows, codes, times, words = _counted(texts)
    if not len(words):
        return pa.array([b""] * len(texts), pa.binary())
    levels = np.searchsorted(_LEVELS, _impacts(times, lengths[rows], corpus)).astype(np.uint8)
    distinct = np.bincount(rows, minlength=len(texts))
    widths = np.where(distinct > 0, 1 << np.ceil(np.log2(np.maximum(4 * distinct, 16))).astype(np.int64), 0)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(HASHES * widths, out=edges[1:])
    sketch = np.zeros(edges[-1], np.uint8)
    hashes = _cells(words.to_pylist())
    for i in range(HASHES):
        np.maximum.at(sketch, edges[rows] + i * widths[rows] + (hashes[i][codes] & (widths[rows] - 1)), levels)
    whole = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(edges), pa.py_buffer(sketch)])
    return whole.cast(pa.binary())


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Index:
    """The stored index: (seq, id, text, sketch) of every document with a term, the lexicon, and the corpus counts."""
    spark = prepared(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_term_counts, "term binary, documents long, occurrences long")
    lexicon = stored(counts.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences")), "search-lexicon")
    found = lexicon.filter("term IS NULL").first()
    corpus = Corpus(*(int(x or 0) for x in (found.documents, found.occurrences) if found) if found else (0, 0))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = _sketched(part["text"], corpus)
                out = pa.record_batch([part["id"], part["text"], made], ["id", "text", "sketch"])
                yield out.filter(pc.greater(pc.binary_length(made), 0))

    sketches = rows.mapInArrow(sketch, "id long, text string, sketch binary").withColumn("seq", F.monotonically_increasing_id())
    return Index(stored(sketches, "search-index", compression="zstd"), lexicon, corpus)


# ---- search


def blocks(items: DataFrame, index: Index, id: str = "item_id", text: str = "text") -> Iterator[Block]:
    """Items in blocks of bounded size, with the weight of each term; items without a term are left out."""
    spark = items.sparkSession
    ids, counted, terms = [], [], {}

    def weighted() -> Block:
        known = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
        shares = {bytes(r.term): r.documents for r in index.lexicon.join(F.broadcast(known), "term").select("term", "documents").collect()}
        n = index.corpus.documents
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * shares.get(t, 0) + 1))) for t in terms]
        places = [np.array([terms[t] for t in c], np.int64) for c in counted]
        return Block(list(ids), list(terms), places, [np.array([weight[terms[t]] * k for t, k in c.items()], np.int64) for c in counted])

    for row in items.select(F.col(id), F.col(text).cast("string")).toLocalIterator():
        own: dict[bytes, int] = {}
        for term in terms_of(pa.array([row[1]], pa.string()))[1].to_pylist():
            own[term] = own.get(term, 0) + 1
        if not own:
            continue
        if ids and len(terms.keys() | own.keys()) > BLOCK_TERMS:
            yield weighted()
            ids, counted, terms = [], [], {}
        ids.append(row[0])
        counted.append(own)
        for term in own:
            terms.setdefault(term, len(terms))
    if ids:
        yield weighted()


def _bounds(sketches: pa.Array, hashes: np.ndarray, block: Block) -> np.ndarray:
    """Upper bound of every item (rows) in every document (columns)."""
    data, offsets = text_bytes(sketches)
    widths = (offsets[1:] - offsets[:-1]) // HASHES
    least = data[offsets[:-1] + (hashes[0][:, None] & (widths - 1))]
    for i in range(1, HASHES):
        np.minimum(least, data[offsets[:-1] + i * widths + (hashes[i][:, None] & (widths - 1))], out=least)
    impacts = _LEVELS.astype(np.float64)[least]
    # Sums stay far below 2^53, so these are whole numbers without rounding.
    return np.stack([w.astype(np.float64) @ impacts[p] for p, w in zip(block.places, block.weights)])


def _exact(texts: pa.Array, block: Block, values: pa.Array, corpus: Corpus) -> np.ndarray:
    """Impact of every term of the block (columns) in every text (rows)."""
    rows, terms = terms_of(texts)
    lengths = np.bincount(rows, minlength=len(texts))
    place = pc.index_in(terms, value_set=values)
    hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
    width = len(block.terms)
    pairs, times = np.unique(rows[hit] * width + place.drop_null().to_numpy(), return_counts=True)
    out = np.zeros((len(texts), width), np.int64)
    out.reshape(-1)[pairs] = _impacts(times, lengths[pairs // width], corpus)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    most = max(1, CELLS // len(block.terms))
    for batch in batches:
        for part in slices(batch, "sketch"):
            for at in range(0, part.num_rows, most):
                yield part.slice(at, most)


class _Best:
    """The best entries per item of what a task has seen: by score, then by id."""

    def __init__(self, items: int, size: int) -> None:
        self.size = size
        self.rows: list[list[tuple]] = [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        mine = self.rows[item]
        mine += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids) if s > 0]
        mine.sort()
        del mine[self.size :]

    def floor(self, item: int) -> int:
        """What a newcomer must reach."""
        return -self.rows[item][-1][0] if len(self.rows[item]) == self.size else 1

    def batch(self) -> pa.RecordBatch:
        flat = [(k, None if r[1] else r[2], int(-r[0])) for k, mine in enumerate(self.rows) for r in mine]
        return pa.record_batch([pa.array([r[j] for r in flat], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "id", "score"])


_FOUND = "item int, id long, score long"


def _highest(found: DataFrame, size: int) -> DataFrame:
    """The best rows of each item with their rank; cut per item and share of ids first, so no task holds all of an item."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    shares = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= size).drop("rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= size)


def _thresholds(index: Index, block: Block, top: int) -> np.ndarray:
    """Per item a score that its last place reaches at least: from the documents with the highest bounds."""
    corpus, hashes, probes = index.corpus, _cells(block.terms), max(PROBES, top)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(block.ids), probes)
        for part in _chunks(batches, block):
            bounds, seq = _bounds(part["sketch"], hashes, block), part["seq"].to_numpy()
            for k in range(len(block.ids)):
                near = np.flatnonzero(bounds[k] >= best.floor(k))
                if len(near) > probes:
                    near = near[np.argpartition(-bounds[k][near], probes)[:probes]]
                best.add(k, bounds[k][near], seq[near].tolist())
        yield best.batch()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(block.terms, pa.large_binary())
        best = _Best(len(block.ids), top)
        for batch in batches:
            for part in slices(batch, "text"):
                impacts, seq = _exact(part["text"], block, values, corpus), part["seq"].to_pylist()
                for k, wanted in enumerate(part["item"].to_pylist()):
                    for item in wanted:
                        best.add(item, impacts[k : k + 1, block.places[item]] @ block.weights[item], seq[k : k + 1])
        yield best.batch()

    probed = _highest(index.rows.select("seq", "sketch").mapInArrow(bound, _FOUND), probes)
    wanted = stored(probed.groupBy(F.col("id").alias("seq")).agg(F.collect_list("item").alias("item")), "search-probes")
    # At most `probes` rows for each item of the block.
    texts = index.rows.select("seq", "text").join(F.broadcast(wanted), "seq")
    places = _highest(texts.mapInArrow(score, _FOUND), top).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    least = np.ones(len(block.ids), np.int64)
    for row in places.collect():
        if row.n == top:
            least[row.item] = row.least
    return least


def search(index: Index, items: DataFrame, top: int = TOP, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with a score above 0, ties by ascending id."""
    spark, out = items.sparkSession, []
    for block in blocks(items, index, id, text):
        names = spark.createDataFrame([(k, v) for k, v in enumerate(block.ids)], f"item int, item_id {items.schema[id].dataType.simpleString()}")
        best = _highest(index.rows.select("id", "text", "sketch").mapInArrow(_rescored(block, index.corpus, _thresholds(index, block, top), top), _FOUND), top)
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema[id].dataType.simpleString()}, rank int, doc_id long, score long")
    # More than one pass: each is stored before the next begins.
    whole = [stored(f, "search-pass") for f in out] if len(out) > 1 else out
    for more in whole[1:]:
        whole[0] = whole[0].unionByName(more)
    return whole[0]


def _rescored(block: Block, corpus: Corpus, least: np.ndarray, top: int):
    """Exact scores in descending order of bounds until nothing can reach the last place any more."""
    hashes, step = _cells(block.terms), 2 * top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(block.terms, pa.large_binary())
        best = _Best(len(block.ids), top)
        for part in _chunks(batches, block):
            bounds, ids = _bounds(part["sketch"], hashes, block), part["id"].to_pylist()
            impacts, known = np.zeros((part.num_rows, len(block.terms)), np.int64), np.zeros(part.num_rows, bool)
            floor = lambda k: max(int(least[k]), best.floor(k))
            queue = {}
            for k in range(len(block.ids)):
                near = np.flatnonzero(bounds[k] >= floor(k))
                if len(near):
                    queue[k] = near[np.argsort(-bounds[k][near], kind="stable")]
            while queue:
                now = {k: near[:step] for k, near in queue.items()}
                fresh = np.unique(np.concatenate(list(now.values())))
                fresh = fresh[~known[fresh]]
                if len(fresh):
                    impacts[fresh] = _exact(part["text"].take(pa.array(fresh)), block, values, corpus)
                    known[fresh] = True
                rest = {}
                for k, near in now.items():
                    scores = impacts[np.ix_(near, block.places[k])] @ block.weights[k]
                    good = scores >= floor(k)
                    best.add(k, scores[good], [ids[i] for i in near[good].tolist()])
                    left = queue[k][step:]
                    left = left[bounds[k][left] >= floor(k)]
                    if len(left):
                        rest[k] = left
                queue = rest
        yield best.batch()

    return run


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
t AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
f AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT rid, sum(tf) AS n FROM f GROUP BY rid),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT rid, CAST(75 + (25 * n * docs) // total AS BIGINT) AS m FROM n, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
q AS (
  SELECT item_id, row_number() OVER () AS qid, text FROM benchmark),
i AS (
  SELECT qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q),
r AS (SELECT qid, item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM r JOIN f USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
