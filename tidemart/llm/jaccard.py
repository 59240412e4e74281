"""Operator 6, n-gram Jaccard join by T-occurrence search with DivideSkip, spread over Spark.

A document's set holds its distinct shingles as 64-bit hashes. Two documents link when
100 * intersection >= percent * union, so a partner of a set of n shares at least T = ceil(percent * n / 100) of its
inverted lists. DivideSkip merges short lists and skips long ones, up to T - 1 of them, which are only probed:

1. Documents with equal sets fold to one. The most frequent shingles (`LONG_LISTS` at most, a fixed bound) are
   found over all documents and all their shingles; they come last in the order of lists. This steers work and never results.
2. Each set sends its first n - T + 1 shingles, its short lists, to the shuffle with the number of its lists from there
   on, its reach: two sets that meet share no more than they met before and the smaller reach. A task folds its own
   occurrences first, so a shingle of a third of all documents stays small; lists of one are dropped.
3. Of two sets that may link where they first meet, the smaller one is early there: its reach would do for a partner of
   its own size. Lists without an early member go, and only early members are compared with the others, in blocks.
   So documents alike in frequent shingles only, which stand last, are never told as pairs.
4. `ROUNDS` rounds take, by sketches, each member's likeliest smaller partner per list outside its component. Links give
   components. A last round merges the lists of all pairs across components: a pair is a candidate if its count and the reach left at its
   last meeting give the overlap needed. No link between different sets is lost, although groups of near copies are
   not expanded into all pairs.
5. Candidates that counts of shingles per hash class (`CLASSES`) do not rule out are verified: texts of candidates
   travel to their query in blocks (`PARTNERS`), the query's once per block; lists of the query over its candidates,
   short ones heap-merged, long ones probed by binary search, exact overlap at the end.

A document with words but fewer than a shingle has one for the whole sequence; one without words or text
has an empty set and links with nothing. Null and repeated ids are kept apart by row number, with which the rows are
stored once and read in every later step. Texts of any length are read whole. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemart.llm import words as W
from tidemart.llm.components import components
from tidemart.llm.session import drop_folders, numbered, prepared, recording, stored, table

SHINGLE = 4
PERCENT = 85
#: Shingles counted more often than this may come last in the order, by powers of two of their counts; of them, the most
#: frequent that fit the bound. A task counts a stretch of shingles of all its documents and tells those met twice in it.
LONG_FROM = 3
LONG_LISTS = 262_144
STRETCH = 8_000_000
#: Members of a list compared at a time. Longer lists are cut, and in the last round one side of the pairs goes to all blocks.
BLOCK = 256
CLASSES = 64
#: Candidates of a query that go to one task with its text.
PARTNERS = 256
#: Rounds of likeliest pairs between components before all pairs across them.
ROUNDS = 2
#: Pairs of list members looked at together.
PAIRS_AT_ONCE = 500_000
ROWS_AT_ONCE = 20_000
FOLD = 2_000_000
BUNDLE = 64


def least_overlap(a, b, percent: int):
    return -(-percent * (a + b) // (100 + percent))


def short_lists(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def sets_of(texts, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = W.text_bytes(texts)
    found = W.split(W.lower_ascii(data), offsets)
    all_ = W.grams(found.hashes, k)
    out = []
    for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            out.append(W.mix(W.grams(found.hashes[a:b], b - a) + W.U64(b - a)))
        else:
            out.append(np.zeros(0, W.U64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _low(tokens: np.ndarray) -> np.ndarray:
    """The lower half of a shingle's hash, enough to order lists by."""
    return (tokens & W.U64(0xFFFFFFFF)).astype(np.uint32)


def _sizes(k: int):
    """Per document its size, a digest of its set, counts per class and a sketch.

    The first row after a stretch of shingles also holds those that were in two of its sets or more, and in how many.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def often() -> tuple[np.ndarray, np.ndarray]:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint32),) * 2
            held.clear()
            return tokens[counts > 1].view(np.int32), counts[counts > 1].astype(np.int64)

        def rows(part, sets: list[np.ndarray], told: bool) -> pa.RecordBatch:
            tokens, counts = often() if told else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            none = [tokens[:0]] * (len(sets) - 1), [counts[:0]] * (len(sets) - 1)
            columns = [
                part["seq"], part["id"], pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([_counts(s) for s in sets], pa.binary()), pa.array(_sketches(sets)), _lists([tokens, *none[0]]), _lists([counts, *none[1]]),
            ]
            return pa.record_batch(columns, ["seq", "id", "size", "set_digest", "counts", "sketch", "often", "often_n"])

        last = None
        for batch in batches:
            for part in W.slices(batch, "text"):
                if last is not None:
                    yield rows(*last, n >= STRETCH)
                    n *= n < STRETCH
                sets = sets_of(part["text"], k)
                held += [_low(s) for s in sets]
                n += sum(map(len, sets))
                last = part, sets
        if last is not None:
            yield rows(*last, True)

    return sizes


_SIZES = "seq long, id long, size long, set_digest binary, counts binary, sketch long, often array<int>, often_n array<long>"


def _heads(k: int, percent: int, long_lists: np.ndarray, levels: np.ndarray):
    """Per document that has shingles its size and its short lists in the order of lists."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                sets = sets_of(part["text"], k)
                first = []
                for s in sets:
                    if len(long_lists) and len(s):
                        half = _low(s)
                        place = np.minimum(np.searchsorted(long_lists, half), len(long_lists) - 1)
                        s = s[np.argsort(np.where(long_lists[place] == half, levels[place], 0), kind="stable")]
                    first.append(s[: short_lists(len(s), percent)])
                columns = [part["seq"], pa.array([len(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in first])]
                yield pa.record_batch(columns, ["seq", "size", "lists"])

    return heads


def _counts(s: np.ndarray) -> bytes:
    """Shingles per hash class as bytes; all 255 if one does not fit, which rules nothing out."""
    n = np.bincount((s >> W.U64(40)).astype(np.int64) % CLASSES, minlength=CLASSES)
    return n.astype(np.uint8).tobytes() if n.max() < 255 else b"\xff" * CLASSES


_BINS = np.arange(16, dtype=W.U64) << W.U64(60)
_ONES = W.U64(0x1111111111111111)


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Four bits of the smallest hash in each sixteenth of the range of hashes."""
    out = np.zeros(len(sets), W.U64)
    for i, s in enumerate(sets):
        if len(s):
            least = s[np.minimum(np.searchsorted(s, _BINS), len(s) - 1)]
            out[i] = np.bitwise_or.reduce((least & W.U64(15)) << (_BINS >> W.U64(58)))
    return out.view(np.int64)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their sixteen parts sketches agree."""
    x = (a ^ b).view(W.U64)
    x = x | (x >> W.U64(1))
    return 16 - np.bitwise_count((x | (x >> W.U64(2))) & _ONES).astype(np.int64)


def _members(percent: int):
    """Members of inverted lists; of those a task holds, the first stands for all and the others are known to have company.

    A member's code is its reach, then a bit if it is early, then one if it has company.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            n = np.diff(np.asarray(b["lists"].offsets))
            total, size = int(n.sum()), b["size"].to_numpy()
            reach = np.repeat(size + np.cumsum(n) - n, n) - np.arange(total)
            early = reach >= np.repeat(least_overlap(size, size, percent), n)
            held.append((b["lists"].flatten().to_numpy(), np.repeat(b["seq"].to_numpy(), n), reach * 4 + early * 2))
            rows += total
            if rows >= FOLD:
                yield _fold(held)
                held, rows = [], 0
        if held:
            yield _fold(held)

    return members


def _fold(held: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held)]
    order = np.argsort(columns[0], kind="stable")
    tokens, seqs, code = (c[order] for c in columns)
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    known = (np.bincount(np.cumsum(first) - 1) > 1)[np.cumsum(first) - 1] if len(tokens) else first
    salt = np.where(first, 0, 1 + seqs % 1021).astype(np.int32)
    return pa.record_batch([pa.array(c) for c in (tokens, salt, seqs, code + known)], ["token", "salt", "seq", "code"])


def repeated_members(heads: DataFrame, percent: int) -> DataFrame:
    """token, seq, reach (the member's lists from this one on) and early, of lists with two members or more."""
    rows = heads.mapInArrow(_members(percent), "token long, salt int, seq long, code long")
    seen = rows.withColumn("n", F.count("*").over(Window.partitionBy("token", "salt"))).filter("code & 1 = 1 OR (salt = 0 AND n > 1)")
    return seen.selectExpr("token", "seq", "shiftright(code, 2) AS reach", "code & 2 = 2 AS early")


# ---- candidates


class _Rows:
    """Members of lists, sorted by list, block, size and row, as numpy columns."""

    def __init__(self, batch: pa.Table, percent: int) -> None:
        names = ("token", "block", "seq", "root", "size", "reach", "own", "wide", "sketch")
        self.token, self.block, self.seq, self.root, self.size, self.reach, self.own, self.wide, self.sketch = (batch[c].to_numpy() for c in names)
        self.percent = percent
        self.change = (self.token[1:] != self.token[:-1]) | (self.block[1:] != self.block[:-1])

    def pairs(self, n: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of the first n rows that may link by what they have left, smaller set first, with need and reach.

        Cut between rows of smaller sets. Both sides sent to all blocks: told at home of the lower row number.
        """
        run = np.concatenate(([0], np.cumsum(self.change)))[:n].astype(np.int64)
        size, reach = self.size[:n], self.reach[:n]
        early = np.flatnonzero(reach >= least_overlap(size, size, self.percent))
        # No partner is larger than what the reach of the smaller set can make up for.
        most = reach[early] * (100 + self.percent) // self.percent - size[early]
        to = np.searchsorted((run << 32) | size, (run[early] << 32) | most, "right")
        some = np.maximum(to - early - 1, 0)
        total = np.cumsum(some)
        at = 0
        while at < len(early):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            n_each = some[at:end]
            a = np.repeat(early[at:end], n_each)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            at = end
            left = np.minimum(self.reach[a], self.reach[b])
            need = least_overlap(self.size[a], self.size[b], self.percent)
            told = np.where(self.seq[a] < self.seq[b], self.own[a], self.own[b]) | ~(self.wide[a] & self.wide[b])
            keep = (left >= need) & (self.root[a] != self.root[b]) & told
            yield a[keep], b[keep], need[keep], left[keep]


def _likeliest(rows: _Rows, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of each larger set's pairs in a list the one of most similar sketches, the smallest set of equal ones."""
    a, b = found[:2]
    order = np.lexsort((a, -_alike(rows.sketch[a], rows.sketch[b]), b))
    first = np.ones(len(order), bool)
    first[1:] = b[order][1:] != b[order][:-1]
    return tuple(c[order[first]] for c in found)


def _pairs(percent: int, forest: bool):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Pairs of all whole runs held; the last run waits for the next batch."""
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            rows = _Rows(table, percent)
            ends = np.flatnonzero(rows.change)
            n = table.num_rows if last else int(ends[-1]) + 1 if len(ends) else 0
            for found in rows.pairs(n):
                a, b, need, left = _likeliest(rows, found) if forest else found
                if len(a):
                    x, y = np.minimum(rows.seq[a], rows.seq[b]), np.maximum(rows.seq[a], rows.seq[b])
                    yield pa.record_batch([pa.array(c) for c in (x, y, need, left)], ["x", "y", "need", "reach"])
            held[:] = table.slice(n).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                yield from cut(False)
        yield from cut(True)

    return pairs


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts per class allow the overlap needed."""
    for batch in batches:
        x, y = (np.frombuffer(W.text_bytes(batch[c])[0], np.uint8).reshape(-1, CLASSES) for c in ("counts_x", "counts_y"))
        open_ = (x == 255).all(axis=1) | (y == 255).all(axis=1)
        keep = open_ | (np.minimum(x, y).sum(axis=1, dtype=np.int64) >= batch["need"].to_numpy())
        yield batch.select(["x", "y"]).filter(pa.array(keep))


# ---- verification


def t_occurrence(lists: list[list[int]], t: int, n: int) -> Counter:
    """DivideSkip: numbers that occur in `t` or more of the sorted lists, with their counts; t >= 1.

    The longest lists, t - 1 at most, are set aside. A number of t lists is in one of the others at least: those are
    merged on a heap, and numbers that can still reach t are looked up in the long ones by binary search.
    """
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    n_long = min(t - 1, max(0, len(lists) - 1))
    short, long = order[: len(order) - n_long], order[len(order) - n_long :]
    seen = Counter(heapq.merge(*(lists[i] for i in short if lists[i])))
    out: Counter = Counter()
    for number, count in seen.items():
        left = n_long
        if count + left < t:
            continue
        for i in reversed(long):
            if count + left < t:
                break
            left -= 1
            row = lists[i]
            at = bisect_left(row, number)
            count += at < len(row) and row[at] == number
        if count >= t:
            out[number] = count
    return out


def _linked(query: np.ndarray, others: list[np.ndarray], percent: int) -> list[bool]:
    """Which candidate sets link with the query's."""
    n = len(query)
    t = max(1, -(-percent * n // 100))
    sizes = np.array([len(o) for o in others])
    flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    place = np.minimum(np.searchsorted(query, flat), n - 1)
    shared = query[place] == flat
    place, owner = place[shared], owner[shared]
    order = np.lexsort((owner, place))
    cuts = np.searchsorted(place[order], np.arange(n + 1))
    members = owner[order].tolist()
    lists = [members[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    counts = t_occurrence(lists, t, len(others))
    return [counts[i] >= least_overlap(n, int(sizes[i]), percent) for i in range(len(others))]


def _verify(k: int, percent: int):
    """A query's row, then those of its candidates, block by block; gives the links."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = np.zeros(0, W.U64)
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for part in W.slices(batch, "text"):
                q, is_query = part["q"].to_numpy(), part["c"].is_null().to_numpy(zero_copy_only=False)
                numbers, sets = part["c"].to_pylist(), sets_of(part["text"], k)
                starts = np.flatnonzero(is_query).tolist()
                for a, b in zip([0, *starts], [*starts, len(q)]):
                    if a < b and is_query[a]:
                        query, a = sets[a], a + 1
                    for low in range(a, b, BUNDLE):
                        some = range(low, min(low + BUNDLE, b))
                        hits = _linked(query, [sets[i] for i in some], percent)
                        linked += [(int(q[i]), numbers[i]) for i, hit in zip(some, hits) if hit]
            yield pa.record_batch([pa.array([p[i] for p in linked], pa.int64()) for i in (0, 1)], ["a", "b"])

    return verify


def _home(turn: int = 0):
    return F.pmod(F.xxhash64("token", "seq", F.lit(turn)), F.ceil(F.col("n") / BLOCK)).cast("int")


class Join:
    """The steps over one table, stored as `numbered`; `classes()` is the result."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> None:
        spark = prepared(docs.sparkSession)
        self.k, self.percent = k, percent
        self.numbered = numbered(docs)
        row = F.col("row")
        self.rows = self.numbered.select("seq", row[id].cast("long").alias("id"), row[text].cast("binary").alias("text"))
        with recording() as made:
            early = stored(self.rows.mapInArrow(_sizes(k), _SIZES), "join-sizes")
        told = early.filter(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "often_n")).alias("o"))
        counts = told.groupBy(F.col("o.often").alias("token")).agg(F.sum("o.often_n").alias("n"))
        often = counts.filter(F.col("n") > LONG_FROM).orderBy(F.desc("n"), "token").limit(LONG_LISTS).collect()
        long_lists, counted = np.array([r.token for r in often], np.int32).view(np.uint32), np.array([r.n for r in often], np.int64)
        order = np.argsort(long_lists)
        long_lists, levels = long_lists[order], np.log2(counted[order]).astype(np.int8)
        self.docs = stored(early.drop("often", "often_n"), "join-docs")
        drop_folders(spark, made)

        same = self.docs.filter("size > 0").groupBy("set_digest").agg(F.min("seq").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
        same = stored(same, "join-copies")
        copies = self.docs.join(same.filter("copies > 1"), "set_digest").filter("seq <> first").select(F.col("seq").alias("a"), F.col("first").alias("b"))
        self.copies = stored(copies, "join-copy-links")

        heads = self.rows.mapInArrow(_heads(k, percent, long_lists, levels), "seq long, size long, lists array<long>")
        heads = heads.filter("size > 0").join(self.copies, F.col("seq") == F.col("a"), "left_anti")
        self.members = stored(repeated_members(heads, percent), "join-members")

        labelled = self.members.withColumn("root", F.col("seq"))
        self.first = links = None
        for turn in range(ROUNDS):
            near = self._nearest(labelled, turn)
            near = stored(near.join(self.first, ["x", "y"], "left_anti") if turn else near, "join-pairs")
            found = stored(self._links(near), "join-links")
            self.first, links = (self.first.union(near), links.union(found)) if turn else (near, found)
            roots = components(links)
            labelled = self.members.join(roots, self.members["seq"] == roots["node"], "left").withColumn("root", F.coalesce("root", "seq")).drop("node")
        self.second = stored(self._across(labelled).join(self.first, ["x", "y"], "left_anti"), "join-pairs")
        self.links = links.union(stored(self._links(self.second), "join-links"))

    def _told(self, rows: DataFrame, forest: bool) -> DataFrame:
        """x < y, need and reach of the pairs that may link, of rows with their block."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sketch = F.col("sketch") if forest else F.lit(0).cast("long").alias("sketch")
        rows = rows.join(self.docs.select("seq", "size", sketch), "seq")
        rows = rows.select("token", "block", "seq", "root", "size", "reach", "wide", "sketch", (F.col("block") == F.col("home")).alias("own"))
        dealt = rows.repartition(n, "token", "block").sortWithinPartitions("token", "block", "size", "seq")
        return dealt.mapInArrow(_pairs(self.percent, forest), "x long, y long, need long, reach long")

    def _nearest(self, members: DataFrame, turn: int) -> DataFrame:
        """Likeliest pairs of different roots; a list's members go to blocks by hash, others each turn, and meet there only."""
        lists = self.members.groupBy("token").agg(F.count("*").alias("n"), F.count_if("early").alias("n_early")).filter("n > 1 AND n_early > 0")
        rows = members.join(lists, "token").withColumn("home", _home(turn)).withColumn("block", F.col("home"))
        return self._told(rows.withColumn("wide", F.lit(False)), forest=True).select("x", "y", "need").distinct()

    def _across(self, members: DataFrame) -> DataFrame:
        """Candidates between components: pairs of different roots whose merged lists leave room for the overlap needed.

        Of a list's pairs one side is early and one is outside its most frequent root. The rarer kind goes to
        every block and pairs there with the block's own.
        """
        per_root = members.groupBy("token", "root").agg(F.count("*").alias("n"), F.count_if("early").alias("n_early"))
        most = F.max(F.struct("n", "root"))
        lists = per_root.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_early").alias("n_early"), F.count("*").alias("n_roots"), most.alias("most"))
        lists = lists.filter("n_roots > 1 AND n_early > 0").select("token", "n", F.col("most.root").alias("major"), F.expr("n_early <= n - most.n").alias("by_early"))
        rows = members.join(lists, "token").withColumn("home", _home())
        rows = rows.withColumn("wide", F.when(F.col("by_early"), F.col("early")).otherwise(F.col("root") != F.col("major")))
        last = F.ceil(F.col("n") / BLOCK).cast("int") - 1
        rows = rows.withColumn("block", F.explode(F.when(F.col("wide"), F.sequence(F.lit(0), last)).otherwise(F.array("home"))))
        met = self._told(rows, forest=False).groupBy("x", "y").agg(F.first("need").alias("need"), F.count("*").alias("n"), F.min("reach").alias("reach"))
        return met.filter("n - 1 + reach >= need").select("x", "y", "need")

    def _links(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs that link."""
        traits = self.docs.select("seq", "counts")
        pairs = pairs.join(traits.select(F.col("seq").alias("x"), F.col("counts").alias("counts_x")), "x")
        pairs = pairs.join(traits.select(F.col("seq").alias("y"), F.col("counts").alias("counts_y")), "y")
        pairs = stored(pairs.mapInArrow(_plausible, "x long, y long"), "join-plausible")
        needed = stored(pairs.select(F.explode(F.array("x", "y")).alias("seq")).groupBy("seq").agg(F.count("*").alias("n")), "join-needed")
        degree = lambda c: needed.select(F.col("seq").alias(c), F.col("n").alias(f"n_{c}"))
        # The document of more pairs is the query; its text travels once per block of candidates.
        turn = F.col("n_x") >= F.col("n_y")
        blocks = F.ceil(F.greatest("n_x", "n_y") / PARTNERS)
        pairs = pairs.join(degree("x"), "x").join(degree("y"), "y").select(
            F.when(turn, F.col("x")).otherwise(F.col("y")).alias("q"), F.when(turn, F.col("y")).otherwise(F.col("x")).alias("c"), blocks.alias("blocks")
        )
        pairs = pairs.select("q", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), "c")
        texts = self.rows.join(needed.filter("n > 0"), "seq").select("seq", "text")
        candidates = pairs.join(texts, F.col("c") == F.col("seq")).select("q", "block", "c", "text")
        queries = pairs.select("q", "block").distinct().join(texts, F.col("q") == F.col("seq")).select("q", "block", F.lit(None).cast("long").alias("c"), "text")
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = queries.union(candidates).repartition(n, "q", "block").sortWithinPartitions("q", "block", F.asc_nulls_first("c"))
        return dealt.mapInArrow(_verify(self.k, self.percent), "a long, b long")

    def classes(self) -> DataFrame:
        """seq, id, size, the component's smallest id and number of rows, and whether the row is its first by id."""
        roots = components(self.links.union(self.copies))
        rows = self.docs.join(roots, self.docs["seq"] == roots["node"], "left").withColumn("root", F.coalesce("root", "seq")).select("seq", "id", "size", "root")
        rows = stored(rows, "join-classes")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "seq")).alias("first")
        groups = rows.groupBy("root").agg(first, F.count("*").alias("members")).filter("members > 1")
        joined = rows.join(groups, "root", "left")
        single = F.col("members").isNull()
        return joined.select(
            "seq", "id", "size", F.when(single, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
            F.coalesce("members", F.lit(1)).alias("members"), (single | (F.col("first.seq") == F.col("seq"))).alias("first"),
        )


def kept_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, columns unchanged, with the one of smallest id left of each component."""
    join = Join(docs, id, text, k, percent)
    gone = stored(join.classes().filter(~F.col("first")).select("seq"), "join-gone")
    return join.numbered.join(gone, "seq", "left_anti").select("row.*")


def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = Join(table(spark, folder, "documents").select("doc_id", "text")).classes()
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


SQL6 = f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM t),
s AS (SELECT DISTINCT doc_id, md5(list_aggregate(words[i:i+{SHINGLE - 1}], 'string_agg', ' ')) AS g
      FROM w, unnest(range(1, greatest(len(words) - {SHINGLE - 2}, 2))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""
