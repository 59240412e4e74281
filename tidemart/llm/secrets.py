"""Operator 10, secret scans: a trigram inverted index decides which texts each rule has to verify.

Every rule is a regular expression; the trigrams a match must contain are derived from it as a Boolean query
(`trigrams.required`). Texts arrive in segments of a few MB; each segment gets an inverted index of the wanted
trigrams over its ASCII-lower-cased bytes, the queries intersect and unite its postings, and only candidates
are verified by the regular expression. A rule without a mandatory trigram scans every text. Segments are
independent, so nothing is shuffled and a lost task is simply run again. Whole texts are searched.

A span is (kind, start, end) in code points, end exclusive; per kind spans are leftmost and do not overlap.
Matches that fail a rule's length test are dropped. Null text counts as empty and has no spans. Null ids,
repeated rows and empty tables pass through; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.llm import trigrams
from tidemart.llm.session import prepared, table
from tidemart.llm.words import lower_ascii, slices, text_bytes


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,20}://[^\s/:@]+:[^\s/@]{3,}@"),
)
RULES = BASE + ADDED
SCHEMA = "id long, spans array<struct<kind:string,start:long,end:long>>"


@cache
def _prepared(rules: tuple[Rule, ...]) -> tuple[list, list[bytes]]:
    made = [(r, re.compile(r.pattern), trigrams.required(r.pattern)) for r in rules]
    return made, sorted(set().union(*(trigrams.trigrams(q) for _, _, q in made)))


def spans_of(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, place of the kind, end) of each text of a segment, sorted."""
    made, wanted = _prepared(rules)
    data, offsets = text_bytes(texts)
    index = trigrams.Index(wanted, lower_ascii(data), offsets)
    found: list[list] = [[] for _ in range(len(texts))]
    strings: dict[int, str] = {}
    for k, (rule, pattern, query) in enumerate(made):
        for row in index.candidates(query).tolist():
            text = strings.get(row)
            if text is None:
                text = strings[row] = texts[row].as_py() or ""
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[row].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and spans of every document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in spans_of(part["text"], rules)]
                yield pa.record_batch([part["id"], pa.array(rows, kind)], ["id", "spans"])

    prepared(docs.sparkSession)
    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(search, SCHEMA)


def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = find(table(spark, folder, "documents"))
    kinds = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(kinds))
    return out.select(F.col("id").alias("doc_id"), *(count(k) for k in kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """All rules over one text, without an index; for tests."""
    found = [
        (m.start(), k, m.end())
        for k, r in enumerate(rules)
        for m in re.finditer(r.pattern, text or "")
        if m.end(r.group) - m.start(r.group) >= r.least
    ]
    return [(rules[k].kind, s, e) for s, k, e in sorted(found)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
