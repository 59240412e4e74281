"""Segmentation by a dictionary against a plain look-up of all substrings."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, run, stream_of
from tidemart.operators import segment
from tidemart.operators.keywords import keyword_counts

WORDS = ["red", "shoe", "shoes", "edsh", "中华", "华人", "中华人民", "人民", "Käse", "a b", "", None, "x1", "é"]
TEXTS = [
    "RedShoes", "red shoes", "中华人民共和国", "中华人民Red9鞋", "käseKÄSE", "", None, "... !", "x1x1y", "🙂red🙂", "カタ1カナred", "é" * 40, "unknown",
    "redred" * 300, "𠀀𠀁red", "a b ab",
]


def alone(c):
    return any(low <= ord(c) <= high for low, high in segment.IDEOGRAPHS) and c.isalnum()


def truth(text, words):
    known = {w.strip().lower() for w in words if w and w.strip() and w.strip().isalnum()}
    out, run = [], ""
    for c in (text or "").lower() + "\n":
        if c.isalnum():
            run += c
            continue
        covered = set()
        for i in range(len(run)):
            for j in range(i + 1, len(run) + 1):
                if run[i:j] in known:
                    out.append(run[i:j])
                    covered |= set(range(i, j))
        stretch = ""
        for i, letter in enumerate(run):
            if i in covered or alone(letter):
                out += [stretch] if stretch else []
                out += [] if i in covered else [letter]
                stretch = ""
            else:
                stretch += letter
        out += [stretch] if stretch else []
        run = ""
    return out


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def cut(spark, texts, dictionary):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, word string").repartition(3)
    return rows_of(segment.segments(rows, "text", dictionary, "found", keep=("id",)))


def expected(texts, words):
    return sorted(((i, w) for i, t in enumerate(texts) for w in truth(t, words)), key=str)


@pytest.mark.parametrize("letters", [segment.MOST_LETTERS, 0])
def test_every_word_at_every_place(spark, dictionary, monkeypatch, letters):
    """By trie, and by join as beyond the size a trie is sent for."""
    monkeypatch.setattr(segment, "MOST_LETTERS", letters)
    assert cut(spark, TEXTS, dictionary) == expected(TEXTS, WORDS)


def test_random_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc中1", k=rng.randint(1, 5))) for _ in range(40)]
    texts = ["".join(rng.choices("abcd中国1 ,", k=rng.randint(0, 60))) for _ in range(300)]
    assert cut(spark, texts, spark.createDataFrame([(w,) for w in words], "word string")) == expected(texts, words)


def test_stretches_do_not_change_the_words(monkeypatch):
    trie = segment.build_trie(["ab", "b", "cab"])
    texts = ["abcab", "", "b b", "cabx", "ab"] * 3
    whole = segment.cut(texts, trie).to_pylist()
    monkeypatch.setattr(segment, "STRETCH", 4)
    assert segment.cut(texts, trie).to_pylist() == whole and whole[0] == ["ab", "b", "cab", "ab", "b"]


def test_empty_dictionary_and_table(spark):
    none = spark.createDataFrame([], "word string")
    assert cut(spark, ["Red shoes", "中华"], none) == [(0, "red"), (0, "shoes"), (1, "中"), (1, "华")]
    assert cut(spark, [], none) == []


def test_stream_counts_words_per_window(spark, folder, dictionary, monkeypatch):
    batches = [[("RedShoes", "2024-01-01 00:00:01"), ("中华人民", "2024-01-01 00:00:03")], [("redred", "2024-01-01 00:00:12")], [("x", "2024-02-01 00:00:00")]]
    schema = "text string, at string"
    stream = stream_of(spark, folder, batches, schema).withColumn("rt", F.to_timestamp("at")).withWatermark("rt", "2 seconds")
    table = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("rt", F.to_timestamp("at"))
    want = rows_of(keyword_counts(table, "text", "rt", version=False, dictionary=dictionary).filter("stt < '2024-02'"))
    got = run(spark, folder, keyword_counts(stream, "text", "rt", version=False, dictionary=dictionary))
    assert rows_of(got.filter("stt < '2024-02'")) == want
    assert ("2024-01-01 00:00:10", "2024-01-01 00:00:20", "search", "red", 2) in want
    monkeypatch.setattr(segment, "MOST_LETTERS", 0)
    with pytest.raises(ValueError):
        keyword_counts(stream, "text", "rt", version=False, dictionary=dictionary)
