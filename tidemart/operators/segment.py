"""Words in text that is written without spaces, by a dictionary.

A run is a stretch of letters and digits. Every place in a run where a word of the dictionary stands gives that word,
nested and overlapping ones too (the finest cut). What no dictionary word covers gives words as well: each ideograph one
of its own, other letters and digits one per stretch. Runs thus stay whole words where the dictionary knows nothing.

The dictionary becomes a trie that all places of an Arrow batch walk at once, a letter per step. It is sent to the
tasks, so its size is checked: one beyond `MOST_LETTERS` is joined to the substrings of the distinct runs instead.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

# The walk travels to the workers by value, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words are runs of letters and digits in any script.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Letters of all dictionary words together that a trie is sent to the tasks for.
MOST_LETTERS = 16_000_000
#: Letters walked at once.
STRETCH = 1 << 21
# Scripts written without spaces: kana, and Han with its extensions and compatibility forms.
IDEOGRAPHS = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

WORDS = T.ArrayType(T.StringType())
_CODES = 0x110000
_SHIFT = 21


class Trie(NamedTuple):
    """State 0 is none. `first` is the state after a first letter, `steps` and `states` all later steps in order."""

    letters: np.ndarray
    first: np.ndarray
    steps: np.ndarray
    states: np.ndarray
    ends: np.ndarray


def build_trie(words: list[str]) -> Trie:
    moves: dict[tuple[int, int], int] = {}
    ends, count = set(), 1
    for word in words:
        at = 0
        for letter in map(ord, word):
            to = moves.get((at, letter))
            if to is None:
                to = moves[at, letter] = count
                count += 1
            at = to
        if at:
            ends.add(at)
    roots = sorted((letter, to) for (at, letter), to in moves.items() if at == 0)
    later = sorted(((at << _SHIFT) | letter, to) for (at, letter), to in moves.items() if at)
    final = np.zeros(count, bool)
    final[list(ends)] = True
    column = lambda rows, i: np.array([r[i] for r in rows], np.int64)
    return Trie(column(roots, 0), column(roots, 1), column(later, 0), column(later, 1), final)


_KINDS: list[tuple[np.ndarray, np.ndarray]] = []


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter or digit, and whether an ideograph; worked out once in a worker."""
    if _KINDS:
        return _KINDS[0]
    word = np.fromiter((chr(c).isalnum() for c in range(_CODES)), bool, _CODES)
    alone = np.zeros(_CODES, bool)
    for low, high in IDEOGRAPHS:
        alone[low : high + 1] = True
    _KINDS.append((word, alone & word))
    return _KINDS[0]


def _followed(steps: np.ndarray, states: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(steps):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(steps, keys), len(steps) - 1)
    return np.where(steps[at] == keys, states[at], 0)


def _walk(codes: np.ndarray, inside: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every dictionary word."""
    table = np.zeros(_CODES, np.int64)
    table[trie.letters] = trie.first
    state = table[codes]
    place = np.flatnonzero((state > 0) & inside)
    state, depth = state[place], 1
    starts, lengths = [place[:0]], [place[:0]]
    while len(place):
        done = place[trie.ends[state]]
        starts.append(done)
        lengths.append(np.full(len(done), depth))
        going = place + depth < len(codes)
        place, state = place[going], state[going]
        ahead = codes[place + depth].astype(np.int64)
        state = np.where(inside[place + depth], _followed(trie.steps, trie.states, (state << _SHIFT) | ahead), 0)
        place, state, depth = place[state > 0], state[state > 0], depth + 1
    return np.concatenate(starts), np.concatenate(lengths)


def _leftovers(codes: np.ndarray, inside: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of what lies inside runs and under no word: ideographs singly, the rest in stretches."""
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + lengths, -1)
    free = inside & (np.cumsum(covered[:-1]) == 0)
    alone = free & _kinds()[1][codes]
    joined = free & ~alone
    first, last = joined.copy(), joined.copy()
    first[1:] &= ~joined[:-1]
    last[:-1] &= ~joined[1:]
    single, head = np.flatnonzero(alone), np.flatnonzero(first)
    return np.concatenate([single, head]), np.concatenate([np.ones(len(single), np.int64), np.flatnonzero(last) + 1 - head])


def _lists(text: str, codes: np.ndarray, begins: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """The words at these places, a list per row that begins at `begins`, in order of place, longer ones first."""
    order = np.lexsort((-lengths, starts))
    starts, lengths = starts[order], lengths[order]
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    edge = np.concatenate(([0], np.cumsum(width)))
    low, size = edge[starts], edge[starts + lengths] - edge[starts]
    offsets = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])
    data = np.frombuffer(text.encode(), np.uint8)[source]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    rows = np.concatenate((np.searchsorted(starts, begins), [len(starts)]))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), words.cast(pa.string()))


def _stretches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > STRETCH:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def cut(texts: list[str], trie: Trie) -> pa.Array:
    """The words of each text. Texts that follow one another are kept apart by a line end, which no word holds."""
    parts = []
    for some in _stretches(texts):
        text = "\n".join(some)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = _kinds()[0][codes]
        starts, lengths = _walk(codes, inside, trie)
        more = _leftovers(codes, inside, starts, lengths)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in some[:-1]], dtype=np.int64))).astype(np.int64)
        parts.append(_lists(text, codes, begins, np.concatenate([starts, more[0]]), np.concatenate([lengths, more[1]])))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def _trie_udf(words: list[str]):
    trie = build_trie(words)

    @F.arrow_udf(WORDS)
    def segments(texts: pa.Array) -> pa.Array:
        return cut(texts.fill_null("").to_pylist(), trie)

    return segments


@F.arrow_udf(WORDS)
def _finish(runs: pa.Array, hits: pa.Array) -> pa.Array:
    """The words of each run from the places where dictionary words stand in it."""
    out = []
    for run, found in zip(runs.to_pylist(), hits.to_pylist()):
        codes = np.frombuffer(run.encode("utf-32-le"), np.uint32)
        starts = np.array([h["place"] - 1 for h in found or []], np.int64)
        lengths = np.array([h["size"] for h in found or []], np.int64)
        more = _leftovers(codes, np.ones(len(codes), bool), starts, lengths)
        out.append(_lists(run, codes, np.zeros(1, np.int64), np.concatenate([starts, more[0]]), np.concatenate([lengths, more[1]])))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def dictionary_words(dictionary: DataFrame, word: str = "word") -> DataFrame:
    """The distinct words that can stand in a run, in lower case, as column `word`."""
    return dictionary.select(F.lower(F.trim(F.col(word))).alias("word")).filter((F.col("word") != "") & ~F.col("word").rlike(SEPARATORS)).distinct()


def segments(df: DataFrame, text: str, dictionary: DataFrame, out: str = "word", keep: tuple[str, ...] = (), word: str = "word") -> DataFrame:
    """One row per word of `text` with the columns `keep`, for tables and streams.

    Text is read whole and in lower case; null text, and text without letters or digits, gives none. Words come as often
    as they occur. A dictionary that grows must be read again by a new query; on a stream it is read when the query
    starts, and must be small enough for a trie.
    """
    known = dictionary_words(dictionary, word).select("word", F.length("word").alias("__size"))
    seen = known.agg(F.sum("__size").alias("letters"), F.max("__size").alias("longest")).first()
    if (seen.letters or 0) <= MOST_LETTERS:
        cutter = _trie_udf([r.word for r in known.select("word").collect()])
        return df.select(*keep, F.explode(cutter(F.lower(text))).alias(out))
    if df.isStreaming:
        raise ValueError(f"a stream takes a dictionary of {MOST_LETTERS} letters at most")
    return _joined(df, text, known, seen.longest, out, keep)


def _joined(df: DataFrame, text: str, known: DataFrame, longest: int, out: str, keep: tuple[str, ...]) -> DataFrame:
    """Each distinct run is cut once: its substrings meet the dictionary in a shuffle join."""
    rows = df.select(*keep, F.explode(F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")).alias("__run"))
    runs = rows.select("__run").distinct()
    size = F.length("__run")
    places = runs.select("__run", F.explode(F.sequence(F.lit(1), size)).alias("place"))
    pieces = places.select("__run", "place", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("place") + 1))).alias("size"))
    hits = (
        pieces.withColumn("word", F.substr("__run", "place", "size")).join(known.select("word"), "word")
        .groupBy("__run").agg(F.collect_list(F.struct("place", "size")).alias("__hits"))
    )
    words = runs.join(hits, "__run", "left").select("__run", _finish("__run", "__hits").alias("__words"))
    return rows.join(words, "__run").select(*keep, F.explode("__words").alias(out))
