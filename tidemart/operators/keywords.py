"""Search keywords: split text into words and count them per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.operators.segment import SEPARATORS, segments
from tidemart.operators.windows import WINDOW, tumble


def words(df: DataFrame, text: str, out: str = "word", pattern: str = SEPARATORS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One lower-case row per word of `text`; the whole text is read, text without words gives none."""
    parts = F.filter(F.split(F.lower(text), pattern), lambda w: w != "")
    return df.select(*keep, F.explode(parts).alias(out))


def keyword_counts(
    df: DataFrame,
    text: str,
    ts: str,
    size: str = WINDOW,
    pattern: str = SEPARATORS,
    source: str | Column = "search",
    version: bool = True,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Words per window; with a `dictionary` (column `word`), those of text without spaces too."""
    if dictionary is None:
        tokens = words(df, text, "keyword", pattern, keep=(ts,))
    else:
        tokens = segments(df, text, dictionary, "keyword", keep=(ts,))
    out = tumble(tokens, ts, size, {"keyword_count": F.count("*")}, ["keyword"], version)
    src = F.lit(source) if isinstance(source, str) else source
    tail = ["ts"] if version else []
    return out.select("stt", "edt", src.alias("source"), "keyword", "keyword_count", *tail)
