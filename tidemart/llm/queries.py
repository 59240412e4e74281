"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemart.llm.archive import SQL8, op8
from tidemart.llm.chat import SQL12, op12
from tidemart.llm.exact import SQL4, op4
from tidemart.llm.gnat import SQL11, op11
from tidemart.llm.jaccard import SQL6, op6
from tidemart.llm.links import SQL9, op9
from tidemart.llm.mixing import SQL1, op1
from tidemart.llm.packing import op5
from tidemart.llm.quality import SQL3, op3
from tidemart.llm.ranked import SQL13, op13
from tidemart.llm.secrets import op10
from tidemart.llm.substrings import SQL7, op7
from tidemart.llm.toxicity import op2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_raked_mixing": op1,
    "op2_subsequence_toxicity": op2,
    "op3_quality_ledger": op3,
    "op4_streaming_exact_dedup": op4,
    "op5_binary_packing": op5,
    "op6_divide_skip_join": op6,
    "op7_seed_and_extend": op7,
    "op8_arc_to_warc": op8,
    "op9_link_trust": op9,
    "op10_trigram_secrets": op10,
    "op11_gnat_negatives": op11,
    "op12_grammar_round_trip": op12,
    "op13_max_sketches": op13,
}
ORACLES: dict[str, str] = {
    name: sql.strip()
    for name, sql in (
        ("op1_raked_mixing", SQL1), ("op3_quality_ledger", SQL3), ("op4_streaming_exact_dedup", SQL4), ("op6_divide_skip_join", SQL6),
        ("op7_seed_and_extend", SQL7), ("op8_arc_to_warc", SQL8),
        ("op9_link_trust", SQL9), ("op11_gnat_negatives", SQL11), ("op12_grammar_round_trip", SQL12), ("op13_max_sketches", SQL13),
    )
}
