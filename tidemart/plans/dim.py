"""The dimension job: configured change events into dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemart import schemas
from tidemart.operators.routing import config_history, latest_config, route_dimensions
from tidemart.sources.text import parse_config_changes, parse_json
from tidemart.streaming.upsert import DimensionStore, write_batch_rows


def route_raw(
    raw: DataFrame, config: DataFrame, value_col: str = "value", history: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(routed, dirty) of raw change-event text. The config is whole before any event is read.

    With `history`, `config` is a `past_config` and events go by the row that held at their own time.
    """
    good, dirty = parse_json(raw, value_col, schemas.CHANGE, exact_numbers=True)
    if not history:
        return route_dimensions(good, config), dirty
    timed = good.withColumn("__ms", F.col("ts") * 1000)
    return route_dimensions(timed, config, event_ms="__ms").drop("__ms"), dirty


def current_config(feed: DataFrame, value_col: str = "value") -> DataFrame:
    return latest_config(parse_config_changes(feed, value_col))


def past_config(feed: DataFrame, value_col: str = "value") -> DataFrame:
    return config_history(parse_config_changes(feed, value_col))


def maintain_dimensions(
    spark: SparkSession, raw: DataFrame, config_feed_path: str, store: DimensionStore, checkpoint: str,
    dirty: str | None = None, history: bool = False,
) -> DataStreamWriter:
    """A stream that keeps all dimension tables up to date; text that is no event goes to the folder `dirty`, if given.

    Each micro-batch reads the config feed afresh, so a new config row takes effect with the
    next batch, and readers of the store always see the last finished batch: there is no cache to clear. With
    `history`, events go by the config row of their own time instead, whenever they are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        feed = batch.sparkSession.read.text(config_feed_path)
        routed, rest = route_raw(batch, past_config(feed) if history else current_config(feed), history=history)
        store.write_batch(routed, batch_id)
        if dirty is not None:
            write_batch_rows(rest, dirty, batch_id)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
