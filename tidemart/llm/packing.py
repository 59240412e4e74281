"""Operator 5, packing: every document is cut into pieces whose lengths are powers of two.

A document of n tokens (its ids and the end id) gives n // LIMIT pieces of LIMIT tokens and one for each set
bit of the rest, longest first. Pieces of one length share a bucket, a folder of the stored result, so a
batch is filled with equal lengths: each piece is a sequence of its own, none crosses documents, and none
needs padding, since every length is a power of two. Sequence ids are given while the pieces are written,
from partition and row, and are fixed from then on; no sort or shuffle is needed.

Null text counts as empty: its document is the end id alone. Null ids and repeated rows are packed like any
other; an empty table gives no pieces; other columns are not read. Texts are split at ASCII white space before they are
encoded, which no token of this vocabulary crosses, so a word seen before costs one lookup. The file of the
tokenizer is a parameter and must be at the same place on every executor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.llm.session import prepared, scratch, table
from tidemart.llm.words import slices

LIMIT = 4096
END = 2
#: Words of a generation; a worker remembers two.
REMEMBERED = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths that n tokens are cut into; `limit` is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Words(dict):
    """Ids of words as little-endian 32-bit bytes; a word without white space is encoded like in its text.

    Marks behind the last letter or digit are one word of their own to the tokenizer, so they are cut off and
    remembered apart. Words not met since the last change of generation are forgotten.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        # Byte-level vocabularies write printable bytes as they are and number the others from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
        others = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            # Up to U+024F lower case is one letter for one and composes with nothing, so it may come first too. Only
            # U+0130 becomes a letter and a mark, which belongs to the run of marks behind it.
            simple = "\u0130" not in text
            if simple and text and max(text) < "\u0250" and "<|" not in text and text != text.lower():
                return self[text.lower().encode()]
            core = text.rstrip(punctuation)
            if simple and len(core) < len(text) and core and "<|" not in text and core[-1] < "\u0250" and (core[-1].isalpha() or core[-1] in "0123456789"):
                ids = self[core.encode()] + self[text[len(core) :].encode()]
                if len(core) <= 4:
                    self[word] = ids
                return ids
            if simple and text.isalpha() and max(text) < "\u0250":
                # One run of letters: only the merges are left to do, on the letters that stand for its bytes.
                found = [t.id for t in self.merges.tokenize(text if text.isascii() else "".join([self.letters[b] for b in word]))]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = np.asarray(found, "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


@cache
def _words(path: str) -> Words:
    return Words(path)


def encode(text: bytes, known: Words) -> bytes:
    # The tokenizer lower-cases; doing it first only brings more equal words. A special token's string must stay as it is.
    if text.isascii() and b"<|" not in text:
        text = text.lower()
    return b"".join(map(known.__getitem__, text.split()))


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """One row per piece, stored with a folder per length."""
    spark = prepared(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts, lengths, sums, totals = [], [], [], [], []
                for doc, text in zip(part["id"].to_pylist(), part["text"].to_pylist()):
                    tokens = encode(text or b"", known) + last
                    total, at = len(tokens) // 4, 0
                    for n in pieces(total, limit):
                        ids.append(doc)
                        starts.append(at)
                        lengths.append(n)
                        sums.append(zlib.crc32(tokens[4 * at : 4 * (at + n)]))
                        totals.append(total)
                        at += n
                columns = [pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums, totals)]
                yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("binary").alias("text"))
    made = source.mapInArrow(cut, SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id())
    folder = scratch(spark, "packed")
    made.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)
    stored = spark.read.schema(f"{SCHEMA}, sequence_id long").parquet(folder)
    return stored.withColumn("offset", F.lit(0).cast("long"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
