"""Operator 7, substring dedup by seed and extend: winnowed anchors join documents, matches grow both ways.

Words are hashed; hashes of `ANCHOR` words are winnowed so that every window of `LENGTH` words holds an anchor,
and equal windows hold the same one. Then:

1. Each document's anchors are stored with its word count, a digest of its word sequence, and its text digest.
2. Anchors that occur twice or more are found. A task first folds its own occurrences, so an anchor that a third of
   all documents share reaches the shuffle as one row per task.
3. Documents with such anchors are read again. Every repeated anchor is extended to the left and right to all
   windows of `LENGTH` words that hold it, and windows that start more than once are found the same way.
4. Runs of repeated windows are the maximal repeats; their words are removed.

Of documents with the same word sequence only one takes part in 3 and 4; all of them lose all words if they
have `LENGTH` or more. Equality is that of 64-bit hashes of words and windows (128 bits for whole documents).

Null text has no words; a document shorter than a window loses nothing. Null and repeated ids are kept apart
by row number, with which the rows are stored once and read in every later step. An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemart.llm import words as W
from tidemart.llm.session import drop_folders, numbered, prepared, recording, stored, table

LENGTH = 35
ANCHOR = 18
#: Occurrences that a task folds at a time.
FOLD = 2_000_000
NOTHING = hashlib.sha256(b"").hexdigest()
_PLACES = "key long, salt int, seq long, place int, known boolean"


def _inside(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether the k words from each place on are of one document."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return (np.arange(total) + k <= ends)[: max(total - k + 1, 0)]


def anchors(found: W.Words, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Places of winnowed anchors: the last smallest of the anchor hashes in each window of `length` words."""
    total, span = len(found.hashes), length - anchor + 1
    if total < length:
        return np.zeros(0, np.int64)
    seeds = W.grams(found.hashes, anchor)
    whole = np.flatnonzero(_inside(found.offsets, length, total))
    back = np.lib.stride_tricks.sliding_window_view(seeds, span)[:, ::-1]
    chosen = np.concatenate([back[part].argmin(axis=1) for part in np.array_split(whole, len(whole) // 65536 + 1)]) if len(whole) else np.zeros(0, np.int64)
    return np.unique(whole + span - 1 - chosen)


def _scan(length: int, anchor: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = W.split(*W.text_bytes(part["text"]))
                at = anchors(found, length, anchor)
                seeds = W.grams(found.hashes, anchor)[at] if len(at) else np.zeros(0, W.U64)
                cuts = np.searchsorted(at, found.offsets)
                n = np.diff(found.offsets)
                local = (at - np.repeat(found.offsets[:-1], np.diff(cuts))).astype(np.int32)
                sums = []
                for i in range(len(n)):
                    run = found.hashes[found.offsets[i] : found.offsets[i + 1]]
                    sums.append(hashlib.blake2b(run.tobytes(), digest_size=16).digest())
                shas = [hashlib.sha256(b" ".join((t.as_py() or b"").split())).hexdigest() for t in part["text"]]
                offsets = pa.array(cuts.astype(np.int32))
                columns = [
                    part["seq"], part["id"], pa.array(n.astype(np.int64)), pa.array(sums, pa.binary()), pa.array(shas),
                    pa.ListArray.from_arrays(offsets, pa.array(seeds.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(local)),
                ]
                yield pa.record_batch(columns, ["seq", "id", "n_words", "words_digest", "sha", "anchors", "places"])

    return scan


def _folded(keys: np.ndarray, seqs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """The first occurrence of each key stands for the task; further ones are known to repeat and need no company."""
    order = np.argsort(keys, kind="stable")
    keys, seqs, places = keys[order], seqs[order], places[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    known = (np.bincount(group) > 1)[group] if len(keys) else np.zeros(0, bool)
    salt = np.where(first, 0, 1 + (seqs + places) % 1021).astype(np.int32)
    columns = [keys.view(np.int64), salt, seqs, places.astype(np.int32), known]
    return pa.record_batch([pa.array(c) for c in columns], ["key", "salt", "seq", "place", "known"])


def _fold(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= FOLD:
            yield _folded(*(np.concatenate(c) for c in zip(*held)))
            held, size = [], 0
    if held:
        yield _folded(*(np.concatenate(c) for c in zip(*held)))


def _seed_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for b in batches:
            n = np.diff(np.asarray(b["anchors"].offsets))
            yield b["anchors"].flatten().to_numpy().view(W.U64), np.repeat(b["seq"].to_numpy(), n), b["places"].flatten().to_numpy()

    return _fold(parts())


def _windows(length: int, anchor: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for b in W.slices(batch, "text"):
                    found = W.split(*W.text_bytes(b["text"]))
                    total = len(found.hashes)
                    if total < length:
                        continue
                    n = np.diff(np.asarray(b["places"].offsets))
                    seeds = np.repeat(found.offsets[:-1], n) + b["places"].flatten().to_numpy()
                    marked = np.zeros(total + 1, np.int32)
                    np.add.at(marked, np.maximum(seeds - (length - anchor), 0), 1)
                    np.add.at(marked, seeds + 1, -1)
                    whole = _inside(found.offsets, length, total)
                    starts = np.flatnonzero((np.cumsum(marked)[: len(whole)] > 0) & whole)
                    doc = np.searchsorted(found.offsets, starts, "right") - 1
                    yield W.grams(found.hashes, length)[starts], b["seq"].to_numpy()[doc], starts - found.offsets[doc]

        return _fold(parts())

    return extend


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, removed, shas = [], [], []
            for seq, text, starts in zip(*(batch[c] for c in ("seq", "text", "places"))):
                words = (text.as_py() or b"").split()
                covered = covered_words(np.asarray(starts.as_py(), np.int64), len(words), length)
                seqs.append(seq.as_py())
                removed.append(int(covered.sum()))
                shas.append(hashlib.sha256(b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone])).hexdigest())
            yield pa.record_batch([pa.array(seqs, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["seq", "n_removed", "sha_kept"])

    return remove


def covered_words(starts: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def _repeated(places: DataFrame) -> DataFrame:
    """seq and the sorted places of its keys that occur elsewhere too."""
    seen = places.withColumn("n", F.count("*").over(Window.partitionBy("key", "salt"))).filter("known OR (salt = 0 AND n > 1)")
    return seen.groupBy("seq").agg(F.sort_array(F.collect_list("place")).alias("places"))


class Repeats:
    """The steps over one table, stored as `numbered`; `spans` and `removed` are its results."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> None:
        if not 1 <= anchor <= length:
            raise ValueError("an anchor must fit into the window")
        spark = prepared(docs.sparkSession)
        self.length = length
        row = F.col("row")
        self.rows = numbered(docs.select(id, text)).select("seq", row[id].cast("long").alias("id"), row[text].cast("binary").alias("text"))
        scanned = self.rows.mapInArrow(
            _scan(length, anchor), "seq long, id long, n_words long, words_digest binary, sha string, anchors array<long>, places array<int>"
        )
        with recording() as made:
            scanned = stored(scanned, "repeat-scan")
        self.docs = stored(scanned.drop("anchors", "places"), "repeat-docs")
        same = self.docs.filter(f"n_words >= {length}").groupBy("words_digest").agg(F.min("seq").alias("first"), F.count("*").alias("copies"))
        self.same = stored(same.filter("copies > 1"), "repeat-copies")
        seeds = scanned.select("seq", "anchors", "places").mapInArrow(_seed_places, _PLACES)
        others = self.docs.join(self.same.filter("copies > 1"), "words_digest").filter("seq <> first").select(F.col("seq").alias("other"))
        found = _repeated(seeds)
        self.seeds = stored(found.join(others, found["seq"] == others["other"], "left_anti"), "repeat-seeds")
        # Anchors are half of what is kept, and the largest shuffles are still to come.
        drop_folders(spark, made)
        windows = self._texts(self.seeds).mapInArrow(_windows(length, anchor), _PLACES)
        self.windows = stored(_repeated(windows), "repeat-windows")

    def _texts(self, found: DataFrame) -> DataFrame:
        """Texts of the documents in `found`, with their places."""
        return self.rows.join(found.filter("size(places) > 0"), "seq").select("seq", "text", "places")

    def removed(self) -> DataFrame:
        """id, n_words, n_removed, kept_sha256 of every document."""
        cut = self._texts(self.windows).mapInArrow(_remove(self.length), "seq long, n_removed long, sha_kept string")
        rows = self.docs.join(self.same.select("words_digest", "copies"), "words_digest", "left").join(cut, "seq", "left")
        copy = F.col("copies").isNotNull() & (F.col("n_words") >= self.length)
        return rows.select(
            F.col("id"), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
        )

    def spans(self) -> DataFrame:
        """id, start and end (in words) of every maximal repeat of the documents that are no copies of another."""
        place = self.windows.select("seq", F.explode("places").alias("start"))
        back = Window.partitionBy("seq").orderBy("start")
        opens = F.when(F.col("start") - F.lag("start").over(back) == 1, 0).otherwise(1)
        runs = place.withColumn("opens", opens).withColumn("run", F.sum("opens").over(back))
        spans = runs.groupBy("seq", "run").agg(F.min("start").alias("start"), (F.max("start") + self.length).alias("end"))
        return spans.join(self.docs.select("seq", "id"), "seq").select("id", "start", "end")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return Repeats(table(spark, folder, "documents").select("doc_id", "text")).removed().withColumnRenamed("id", "doc_id")


SQL7 = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, i, md5(list_aggregate(words[i:i+{LENGTH - 1}], 'string_agg', ' ')) AS g FROM w, unnest(range(1, len(words) - {LENGTH - 2})) AS r(i)),
d AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT doc_id, list(DISTINCT i + o) AS gone FROM d, unnest(range(0, {LENGTH})) AS q(o) GROUP BY doc_id),
k AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN c USING (doc_id)),
x AS (SELECT doc_id, string_agg(words[i], ' ' ORDER BY i) AS kept FROM k, unnest(range(1, len(words) + 1)) AS r(i) WHERE NOT list_contains(gone, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN x USING (doc_id)
"""
