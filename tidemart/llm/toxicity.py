"""Operator 2, toxicity: a support vector machine on the gap-weighted subsequence kernel, with Nyström landmarks.

The kernel compares words by the subsequences of `ORDER` letters they share; each counts less the more it is
stretched, so insults with gaps or inserted characters stay close to the plain ones, and it is normalised by
both words' own kernels. Landmarks map words to K(landmarks)^-1/2 k(word), on which a linear machine with squared hinge
loss is trained. Its expansion over landmarks is one table of weights per subsequence, so a word's decision costs
its subsequences only, however many landmarks there are.

A labelled document is a bag of sentences, a sentence a bag of words. The machine learns on words of labelled sentences:
those that prefer toxic documents beyond chance against common and hard ones of clean documents. A document is
scored by its most toxic words: a logistic curve over the largest decision and the mean of the three largest,
fitted on the training documents.

Training uses the first `TOXIC` toxic and `CLEAN` clean rows by hash of id; both are documented bounds, and what
reaches the driver is bounded by them and by `WORDS`. All texts are scored whole, in tasks, without a shuffle.

Null and empty texts have no words and get the curve's value for a decision of -1. Without labels of both kinds
every document scores 0. Null ids are scored and count as held out only if their remainder says so (it is null: false).
Null labels are ignored; a document labelled twice is toxic if either says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.llm import words as W
from tidemart.llm.session import prepared, stored, table

ORDER = 3
DECAY = 0.6
LONGEST = 24
TOXIC, CLEAN = 2000, 4000
WORDS = 20_000
#: Times as often in toxic documents as in clean ones that a word of toxic sentences must be.
PREFERENCE = 20
LANDMARKS = 128
FLOOR = -1.0
#: Letters of the alphabet the kernel sees: a-z, digits that stand for letters, and other letters by four classes.
CODES = np.zeros(256, np.uint8)
CODES[97:123] = np.arange(1, 27)
CODES[65:91] = np.arange(1, 27)
for _digit, _letter in zip(b"013457", b"oieast"):
    CODES[_digit] = _letter - 96
CODES[128:192] = 28 + (np.arange(128, 192) & 3)
BASE = 32


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(w, w) of words of one length (a row each), by dynamic programming over prefixes."""
    rows, n = codes.shape
    equal = (codes[:, :, None] == codes[:, None, :]).astype(np.float64) * DECAY**2
    before = np.ones((n + 1, n + 1, rows))
    for _ in range(ORDER - 1):
        now = np.zeros((n + 1, n + 1, rows))
        for a in range(1, n + 1):
            run = np.zeros(rows)
            for b in range(1, n + 1):
                run = DECAY * run + equal[:, a - 1, b - 1] * before[a - 1, b - 1]
                now[a, b] = DECAY * now[a - 1, b] + run
        before = now
    return np.einsum("rab,abr->r", equal, before[:n, :n])


def weighted(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of table weights over the subsequences of words of one length, each decayed by its stretch."""
    out = np.zeros(len(codes))
    wide = codes.astype(np.int32)
    for places in combinations(range(codes.shape[1]), ORDER):
        at = wide[:, places[0]]
        for p in places[1:]:
            at = at * BASE + wide[:, p]
        out += DECAY ** (places[-1] - places[0] + 1) * table[at]
    return out


def subsequences(word: bytes) -> dict[int, float]:
    """Decayed counts of a word's subsequences, the explicit image of the kernel."""
    out: dict[int, float] = {}
    for places in combinations(range(len(word)), ORDER):
        at = 0
        for p in places:
            at = at * BASE + word[p]
        out[at] = out.get(at, 0.0) + DECAY ** (places[-1] - places[0] + 1)
    return out


def decisions(words: list[bytes] | np.ndarray, lengths: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Decision per word; `words` is a padded matrix of codes with LONGEST columns."""
    out = np.full(len(lengths), bias)
    for n in np.unique(lengths):
        if n < ORDER:
            continue
        rows = np.flatnonzero(lengths == n)
        for part in np.array_split(rows, len(rows) // 4096 + 1):
            codes = words[part, :n]
            out[part] += weighted(codes, table) / np.sqrt(self_kernel(codes))
    return out


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(words), LONGEST), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w[:LONGEST], np.uint8)
    return out, np.array([min(len(w), LONGEST) for w in words], np.int64)


class Units(NamedTuple):
    """Distinct words of a batch as codes, and for each occurrence its row and word."""

    codes: np.ndarray
    lengths: np.ndarray
    row: np.ndarray
    word: np.ndarray


def units(texts) -> Units:
    """Words by their letters. Three or more single letters in a row count as one word too, a long word as overlapping pieces."""
    data, offsets = W.text_bytes(texts)
    found = W.split(data, offsets)
    codes = CODES[data]
    kept = np.concatenate(([0], np.cumsum(codes > 0)))
    codes = codes[codes > 0]
    low, high = kept[found.starts], kept[found.ends]
    row = np.searchsorted(found.offsets, np.arange(len(low)), "right") - 1
    single = high - low == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
    joined = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = [a, *(np.flatnonzero(row[a + 1 : b] != row[a : b - 1]) + a + 1).tolist(), b]
        joined += [(low[x], high[y - 1], row[x]) for x, y in zip(cuts[:-1], cuts[1:]) if y - x >= 3]
    if joined:
        extra = np.array(joined, np.int64)
        low, high, row = np.concatenate((low, extra[:, 0])), np.concatenate((high, extra[:, 1])), np.concatenate((row, extra[:, 2]))
    some = high - low >= ORDER
    low, high, row = low[some], high[some], row[some]
    long = high - low > LONGEST
    if long.any():
        cut = [(s, min(s + LONGEST, h), r) for l, h, r in zip(low[long].tolist(), high[long].tolist(), row[long].tolist()) for s in range(l, h - ORDER + 1, LONGEST // 2)]
        extra = np.array(cut, np.int64)
        low, high, row = (np.concatenate((x[~long], extra[:, i])) for i, x in enumerate((low, high, row)))
    n = high - low
    # Words as keys: hash of their codes, so that each distinct one is looked at once.
    run = np.concatenate((codes, np.zeros(LONGEST, np.uint8)))
    key = W._hashes(run, low, high) if len(low) and (low[1:] >= high[:-1]).all() else _slow_hashes(run, low, high)
    _, first, word = np.unique(key, return_index=True, return_inverse=True)
    places = low[first][:, None] + np.arange(LONGEST)
    wide = np.where(np.arange(LONGEST) < n[first][:, None], run[np.minimum(places, len(run) - 1)], 0).astype(np.uint8)
    return Units(wide, n[first], row, word.reshape(-1))


def _slow_hashes(run: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of ranges in any order, at most LONGEST bytes each."""
    out, powers = np.zeros(len(low), W.U64), np.cumprod(np.full(LONGEST, W._P))
    for i in range(LONGEST):
        at = low + i
        inside = at < high
        out[inside] += (run[at[inside]].astype(W.U64) + W.U64(1)) * powers[i]
    return W.mix(out)


class Model(NamedTuple):
    table: np.ndarray
    bias: float
    curve: tuple[float, float, float]


def features(texts, table: np.ndarray, bias: float) -> np.ndarray:
    """Per text the largest decision of its words and the mean of the three largest."""
    u = units(texts)
    out = np.full((len(texts), 2), FLOOR)
    if not len(u.row):
        return out
    each = decisions(u.codes, u.lengths, table, bias)
    # A word counts once per text: three different words weigh more than one repeated.
    pairs = np.unique(u.row * np.int64(len(each)) + u.word)
    row, value = pairs // len(each), each[pairs % len(each)]
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    start = np.searchsorted(row, np.arange(len(texts)))
    end = np.searchsorted(row, np.arange(len(texts)), "right")
    top = [np.where(start + i < end, value[np.minimum(start + i, len(value) - 1)], FLOOR) for i in range(3)]
    some = end > start
    out[some, 0] = np.maximum(top[0][some], FLOOR)
    out[some, 1] = np.maximum(np.mean(top, axis=0)[some], FLOOR)
    return out


def scores(texts, model: Model | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    x = features(texts, model.table, model.bias)
    a, b, c = model.curve
    return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -50, 50)))


# ---- training


def _tail(t: int, c: int, share: float) -> float:
    """Chance that t or more of t + c documents are toxic."""
    n = t + c
    term = lambda k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)
    return float(sum(np.exp(term(k)) for k in range(t, min(n, t + 60) + 1)))


def _image(words: list[bytes], index: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(words), len(index)))
    for i, w in enumerate(words):
        for at, x in subsequences(w[:LONGEST]).items():
            if at in index:
                out[i, index[at]] = x
    return out


def disguises(word: bytes) -> list[bytes]:
    """The word with one more letter at each place inside it."""
    return [word[:i] + bytes([1 + (7 * i + word[i]) % 26]) + word[i:] for i in range(1, min(len(word), LONGEST - 1))]


def fit_machine(good: list[bytes], bad: list[bytes], penalty: float = 0.001) -> tuple[np.ndarray, float]:
    """Table and bias of the machine that tells `bad` words and their disguises from `good` ones.

    Landmarks are the first words of both lists.
    """
    marks = bad[: LANDMARKS * 3 // 4] + good[: LANDMARKS - min(len(bad), LANDMARKS * 3 // 4)]
    index = {at: i for i, at in enumerate(sorted(set().union(*(subsequences(m[:LONGEST]) for m in marks))))}
    own = lambda ws: np.sqrt([sum(x * x for x in subsequences(w[:LONGEST]).values()) for w in ws])
    known = set(good)
    bad = bad + [d for w in bad for d in disguises(w) if len(w) > ORDER and d not in known]
    land = _image(marks, index) / own(marks)[:, None]
    values, vectors = np.linalg.eigh(land @ land.T)
    keep = values > 1e-8
    root = vectors[:, keep] / np.sqrt(values[keep])
    rows = bad + good
    z = _image(rows, index) / own(rows)[:, None] @ land.T @ root
    z = np.hstack((z, np.ones((len(rows), 1))))
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    weight = np.where(y > 0, len(rows) / (2 * len(bad)), len(rows) / (2 * len(good)))
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        za = z[active] * weight[active, None]
        fresh = np.linalg.solve(penalty * len(rows) / len(bad) * np.eye(len(w)) + za.T @ z[active], za.T @ y[active])
        if np.abs(fresh - w).max() < 1e-6:
            break
        w = fresh
    out = np.zeros(BASE**ORDER)
    out[list(index)] = (root @ w[:-1]) @ land
    return out, float(w[-1])


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve over the two features, both classes with the same weight."""
    z = np.hstack((x, np.ones((len(x), 1))))
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag([0.05, 0.05, 1e-6]) * len(y) / 50
        step = np.linalg.solve(hess, z.T @ (weight * (y - p)) - np.array([0.05, 0.05, 1e-6]) * len(y) / 50 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct words, with its label."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            u = units(part["text"])
            pairs = np.unique(u.row * np.int64(max(len(u.lengths), 1)) + u.word)
            row, word = pairs // max(len(u.lengths), 1), pairs % max(len(u.lengths), 1)
            texts = [u.codes[w, : u.lengths[w]].tobytes() for w in range(len(u.lengths))]
            yield pa.record_batch([pa.array([texts[w] for w in word.tolist()], pa.binary()), part["toxic"].take(pa.array(row))], ["word", "toxic"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the bounded training sample: labelled documents outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("order", F.xxhash64("doc_id"))
    pick = lambda test, n: rows.filter(test).orderBy("order", "doc_id").limit(n)
    sample = stored(pick("toxic > 0", TOXIC).union(pick("toxic <= 0", CLEAN)).select("doc_id", "toxic"), "toxic-sample")
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    # Near copies would pass off the words they share as signs of their label: one row stays per pair of smallest word hashes.
    long = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 5)
    least = F.slice(F.array_sort(F.array_distinct(F.transform(long, lambda w: F.xxhash64(w)))), 1, 2)
    marked = rows.withColumn("mark", F.when(F.size(least) == 2, least).otherwise(F.array("doc_id")))
    one = marked.groupBy("mark").agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("doc_id"), "doc_id")).alias("one"))
    return stored(one.select("one.*"), "toxic-training")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = training_rows(docs, labels)
    counts = {bool(r.t): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic or not n_clean:
        return None
    words = rows.mapInArrow(_doc_words, "word binary, toxic int").groupBy("word")
    words = stored(words.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("c")), "toxic-words")
    n_words = words.count()
    apart = words.filter((F.col("t") >= 2) & (F.col("t") * n_clean >= PREFERENCE * (F.col("c") + 0.5) * n_toxic)).orderBy(F.desc("t"), "word").limit(WORDS).collect()
    share = n_toxic / (n_toxic + n_clean)
    bad = [bytes(r.word) for r in apart if _tail(r.t, r.c, share) * n_words < 1]
    if not bad:
        bad = [bytes(r.word) for r in apart[:10]]
    clean = words.filter(F.col("c") > 0).orderBy(F.desc("c"), "word").limit(WORDS).collect()
    good = [w for w in (bytes(r.word) for r in clean) if w not in set(bad)]
    if not bad or not good:
        return None
    kernel, bias = fit_machine(good[:2000], bad)
    codes, lengths = matrix(good)
    for _ in range(2):
        hard = np.argsort(-decisions(codes, lengths, kernel, bias))[:1500]
        pool = list(dict.fromkeys(good[:2000] + [good[i] for i in hard]))
        kernel, bias = fit_machine(pool, bad)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                x = features(part["text"], kernel, bias)
                yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), part["toxic"]], ["a", "b", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(measured, "a double, b double, toxic int").toPandas()
    curve = fit_curve(seen[["a", "b"]].to_numpy(), (seen["toxic"] > 0).to_numpy().astype(float))
    return Model(kernel, bias, curve)


def score(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield pa.record_batch([part["id"], pa.array(scores(part["text"], model))], ["id", "score"])

    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(run, "id long, score double")


def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    out = score(docs, train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
