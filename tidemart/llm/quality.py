"""Operator 3, quality rules: a ledger of rule failures as bits beside the measurements they came from.

Every rule is evaluated once per document; bit k of `failure_bits` says that rule k failed. A policy is a
named, versioned set of rules, so changing it reads the ledger, never the texts, and ablations are counts
per distinct bitmask. All of it is DataFrame functions: word windows are compared within the row, by sorting
their hashes, so a document of any length costs n log n and nothing is exploded or shuffled.

Null text has no words, lines or symbols. Null ids are kept. Repeated rows are judged one by one. An empty
table gives an empty ledger. Columns of the input other than id and text never reach the measurements.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.llm.session import WHITE, table

WINDOW = 8


class Rule(NamedTuple):
    name: str
    fails: str


class Policy(NamedTuple):
    name: str
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("shouting", "10 * n_bangs > 3 * n_words"),
    Rule("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("clean", 2, tuple(r.name for r in RULES)))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(name) for name in policy.rules)


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _pairs(array: Column, by: int) -> Column:
    """Hash of each entry with the one `by` later; entries without one are left out."""
    n = F.greatest(F.size(array) - by, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), _shifted(array, by), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), mark equal neighbours, add up the steps."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    both = F.zip_with(F.slice(ranked, 1, F.size(ranked) - 1), _shifted(ranked, 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), _shifted(places, 1), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda total, step: total + step)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents as struct `row`, with the measurements beside it."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.struct("*").alias("row"), docs[text].alias("text")).withColumn("text", plain)
    trimmed = F.btrim("text", F.lit(WHITE))
    lists = held.select(
        "row", "text",
        F.when(F.length(trimmed) > 0, F.split(trimmed, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0).alias("lines"),
    )
    hashed = lists.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    twos = hashed.withColumn("windows", _pairs(F.col("hashes"), 1))
    fours = twos.withColumn("windows", _pairs(F.col("windows"), 2))
    eights = fours.withColumn("windows", _pairs(F.col("windows"), 4))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return eights.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(some, _covered(F.col("windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("!").alias("n_bangs"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`row`, the measurements and `failure_bits`."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    return measure(docs, text).withColumn("failure_bits", bits.cast("long"))


def failed(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def kept_rows(docs: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents, columns unchanged, that pass the policy.

    The bits leave through a generator: a filter on them would else be pushed below their projections, which
    writes every measurement out anew wherever a rule names it.
    """
    book = ledger(docs, rules, text).select("row", F.inline(F.array(F.struct("failure_bits"))))
    return book.filter(~failed(policy, rules)).select("row.*")


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents it fails, and documents that only it fails, kept if the rule were dropped.

    Documents are first counted per bitmask, so only distinct masks are compared with the policies.
    """
    masks = book.groupBy("failure_bits").agg(F.count("*").alias("n"))
    one = F.array(
        *(
            F.struct(
                F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(name).alias("rule"),
                F.lit(mask(p, rules)).cast("long").alias("all"), F.lit(mask(Policy("", 0, (name,)), rules)).cast("long").alias("bit"),
            )
            for p in policies
            for name in p.rules
        )
    )
    each = masks.select("failure_bits", "n", F.explode(one).alias("p")).select("failure_bits", "n", "p.*")
    hit = F.col("failure_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failure_bits").bitwiseAND(F.col("all")) == F.col("bit")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return each.groupBy("policy", "version", "rule").agg(total(hit).alias("n_failed"), total(alone).alias("n_only"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    book = ledger(table(spark, folder, "documents").select("doc_id", "text"))
    base = failed(BASE)
    return book.select(
        "row.doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & ~failed(POLICIES[-1])).alias("kept"),
        *MEASURES[5:], "failure_bits", F.lit(POLICIES[-1].version).alias("policy_version"),
    )


SQL3 = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT k, i, list_aggregate(words[i:i+7], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS r(i)),
d AS (SELECT k, i FROM p QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM d, unnest(range(0, 8)) AS q(o) GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
       length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
       coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bangs
      FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN 10 * n_bangs > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 32 ELSE 0 END
       + CASE WHEN word_chars > 15 * n_words THEN 64 ELSE 0 END AS failure_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
       failure_bits = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bangs AS BIGINT) AS n_bangs,
       CAST(failure_bits AS BIGINT) AS failure_bits, 2 AS policy_version
FROM b
"""
