"""Config-driven routing of change events to dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window, functions as F, types as T

from tidemart.operators.dedup import latest_per_key

ROUTED_TYPES = ("insert", "update", "bootstrap-insert")


def latest_config(changes: DataFrame, order: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Current config rows from their change feed; deletes leave the last row standing."""
    upserts = changes.filter(F.col("after").isNotNull()).select("after.*", *order)
    return latest_per_key(upserts, ["source_table"], order).drop(*order)


def config_history(changes: DataFrame, order: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Every config row with the time it holds: from `valid_from` up to, not including, `valid_to`, in milliseconds.

    A row of the first snapshot (`op` r) holds from the beginning, the newest without end; deletes leave the last row
    standing. Of rows with one time the last in `order` holds.
    """
    upserts = changes.filter(F.col("after").isNotNull()).select("after.*", "op", *order)
    rows = Window.partitionBy("source_table").orderBy(*order)
    first = F.row_number().over(rows) == 1
    return upserts.select(
        *(c for c in upserts.columns if c not in ("op", *order)),
        F.when(~(first & (F.coalesce("op", F.lit("")) == "r")), F.col("ts_ms")).alias("valid_from"),
        F.lead("ts_ms").over(rows).alias("valid_to"),
    )


def route_dimensions(
    df: DataFrame, config: DataFrame, types: Sequence[str] = ROUTED_TYPES, event_ms: str | None = None
) -> DataFrame:
    """Change events of configured tables with their target table and only its columns.

    Unconfigured tables drop out. Column names in the config match exactly, blanks included. With `event_ms`, the
    events' time in milliseconds, `config` is a `config_history` and each event goes by the row that held at its time,
    so that a replay routes as the first run did. A table has few config rows, so an event meets few.
    """
    targets = config.select(
        F.col("source_table").alias("__source"),
        F.col("sink_table"),
        F.split("sink_columns", ",").alias("__columns"),
        F.when(F.coalesce("sink_pk", F.lit("")) == "", "id").otherwise(F.col("sink_pk")).alias("sink_pk"),
        *(["valid_from", "valid_to"] if event_ms else []),
    )
    match = F.col("table") == F.col("__source")
    if event_ms:
        at = F.col(event_ms)
        match = match & (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    hit = df.filter(F.col("type").isin(list(types))).join(targets, match, "inner")
    kept = F.map_filter("data", lambda k, v: F.array_contains("__columns", k))
    return hit.withColumn("data", kept).drop("__source", "__columns", "valid_from", "valid_to")


def dim_schema(config_row: Row) -> T.StructType:
    """All-text layout of a dimension table; its key column is not nullable."""
    pk = config_row["sink_pk"] or "id"
    return T.StructType(
        [T.StructField(c, T.StringType(), c != pk) for c in config_row["sink_columns"].split(",")]
    )
