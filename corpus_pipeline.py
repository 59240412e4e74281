"""From raw documents to packed training sequences, one stored step after another.

Quality rules, exact dedup, near-duplicate join, source mixing, packing. Every stage reads all that its
predecessor kept, and what it decides takes effect. All but the last return the columns of the documents, columns of
any other name along with them.

A stage's result is read from folders of its own until it has been stored. What a stage leaves behind goes when a later
stage begins that no longer reads it: do not keep the unstored result of one stage while another runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemart.llm import exact, jaccard, mixing, packing, quality
from tidemart.llm.session import drop_folders, prepared, recording, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

_left: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, begun by deleting what earlier ones left and its input is not read from."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        kept = drop_folders(spark, _left.pop(session, []), still_read=docs)
        with recording() as made:
            out = stage(spark, docs, sf_dir)
        _left[session] = kept + made
        return out

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the newest policy; null and empty texts have no words and go.

    Repeated rows and ties are judged each for itself, texts of any length whole; an empty table stays empty.
    """
    prepared(spark)
    return quality.kept_rows(docs)


@_tidy
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id; null counts as empty, null ids as smallest.

    Of rows that also share the id one stays. Texts of any length are compared whole; an empty table stays empty.
    """
    return exact.kept_rows(docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; of each component the row with the smallest doc_id stays.

    Texts without words, null ones among them, are near to nothing and stay. Of rows that share the smallest id one
    stays. Texts of any length are read whole; an empty table stays empty.
    """
    return jaccard.kept_rows(docs, k=5, percent=80)


@_tidy
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stated share of all tokens, sampled by raked probabilities; null languages and sources are categories.

    Whether a row stays depends on its id: rows that repeat an id, and those without, stay or go together. An empty
    table stays empty.
    """
    prepared(spark)
    return mixing.sampled_rows(docs, keep=mixing.KEEP)


@_tidy
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a power of two tokens; null and empty texts give the end token alone, rows with one id each their own."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: The packing stage needs a tokenizer, which SQL does not have; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Of the folders they make only that of the result is left."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with recording() as made:
            docs = stored(out, f"pipeline-{name}")
        drop_folders(spark, [*before, *_left.pop(spark.sparkContext.applicationId, [])])
        before = made
    return docs
