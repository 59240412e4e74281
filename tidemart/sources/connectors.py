"""Readers: Kafka topics, JDBC tables, files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemart import schemas
from tidemart.functions.values import camel_names
from tidemart.operators.dedup import latest_per_key
from tidemart.operators.serve import of_day, with_day
from tidemart.sources.text import parse_changes, parse_json


def kafka_options(servers: str, topic: str, starting: str = "latest", **extra: str) -> dict[str, str]:
    """Options of a Kafka source; offsets live in the query's checkpoint, not in a consumer group."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        **extra,
    }


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **extra: str) -> DataFrame:
    """Topic values as text with their partition and offset; null values become blank."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting, **extra)).load()
    return raw.select(
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), "partition", "offset"
    )


def read_kafka_json(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, starting: str = "latest", **extra: str
) -> DataFrame:
    return parse_json(read_kafka(spark, servers, topic, starting, **extra), "value", schema, ("partition", "offset"))[0]


def read_kafka_changes(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    return parse_changes(read_kafka(spark, servers, topic, starting), keep=("partition", "offset"))


def jdbc_options(url: str, user: str, password: str, driver: str, **extra: str) -> dict[str, str]:
    return {"url": url, "user": user, "password": password, "driver": driver, **extra}


def jdbc_source(table: str | None = None, query: str | None = None) -> str:
    """A query goes in brackets where a table stands: the `query` option excludes partitioned reads."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    return table if table is not None else f"({query}) AS source"


def read_jdbc(
    spark: SparkSession, options: dict[str, str], table: str | None = None, query: str | None = None, to_camel: bool = False
) -> DataFrame:
    """A table or a query; pass partitionColumn, bounds and numPartitions in `options` for a parallel read."""
    df = spark.read.format("jdbc").options(**options, dbtable=jdbc_source(table, query)).load()
    return camel_names(df) if to_camel else df


def read_dictionary(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    """The code dictionary; a streaming join re-reads it with every micro-batch."""
    return read_jdbc(spark, options, table=table).select(*schemas.DICTIONARY.names)


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(folder)


def store_summary(df: DataFrame, path: str, mode: str = "append") -> None:
    """Window rows with their version column `ts`: a partition per month, days in order within its files.

    A partition per day would leave thousands of tiny files; within a month the day is found by file statistics.
    """
    rows = with_day(df).hint("rebalance", F.col("month")).sortWithinPartitions("month", "day")
    rows.write.mode(mode).partitionBy("month").parquet(path)


def read_summary(spark: SparkSession, path: str, keys: Sequence[str] = (), date: int | None = None) -> DataFrame:
    """A summary table as dashboards read it: of repeated writes of a window row, the newest.

    With `date`, yyyyMMdd, only that day of a table by `store_summary` is read.
    """
    rows = spark.read.parquet(path)
    return latest_per_key(rows if date is None else of_day(rows, date), ["stt", "edt", *keys], ["ts"])
