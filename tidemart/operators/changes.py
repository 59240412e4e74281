"""Projections and predicates over database change events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def changed(column: str) -> Column:
    """True when an update touched `column`: its former value is present."""
    return F.col("old")[column].isNotNull()


def became(column: str, new: str, former: str | None = None) -> Column:
    """True when `column` now holds `new`; with `former`, only if it held that before."""
    now = F.col("data")[column] == new
    return now & (F.col("old")[column] == former) if former is not None else now


def change_events(
    df: DataFrame,
    table: str,
    columns: Sequence[str] | Mapping[str, str],
    types: Sequence[str] | None = None,
    database: str | None = None,
    where: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of one source table as flat string columns.

    `columns` names payload fields, or maps an output name to a payload field; `keep` passes
    envelope columns through. A payload field the event lacks becomes NULL.
    """
    cond = F.col("table") == table
    if database is not None:
        cond = cond & (F.col("database") == database)
    if types is not None:
        cond = cond & F.col("type").isin(list(types))
    if where is not None:
        cond = cond & where
    names = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    return df.filter(cond).select(
        *(F.col("data")[src].alias(out) for out, src in names.items()),
        *(F.col(k) for k in keep),
    )


def positive_delta(df: DataFrame, column: str, type_col: str = "type", out: str | None = None) -> DataFrame:
    """Quantity added by each event: all of it on insert, the increase on update.

    Updates that leave the quantity alone or lower it are dropped.
    """
    new, old = F.col("data")[column], F.col("old")[column]
    grown = new.try_cast("int") - old.try_cast("int")
    insert = F.col(type_col) == "insert"
    return df.filter(insert | ((F.col(type_col) == "update") & (grown > 0))).withColumn(
        out or column, F.when(insert, new).otherwise(grown.cast("string"))
    )


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select by name into a sink layout: output name -> input name."""
    return df.select(*(F.col(src).alias(out) for out, src in names.items()))
