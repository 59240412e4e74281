"""Keyed tables as appended versions.

Each micro-batch of a `foreachBatch` stream writes its newest row per key as one partition, named by the batch's id. A
batch that runs again after a failure replaces its own partition and no other. Readers scan the table once, whatever
the number of batches, and keep the newest version per key.

On plain files a reader may meet a batch while it is being written or replaced. Where that matters the same rows go to
a table format with atomic commits; nothing else here would change. A table that has grown many batches is folded into
a fresh one by `compact`, and the stream goes on with that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemart.operators.dedup import latest_per_key
from tidemart.operators.routing import dim_schema

BATCH = "batch_id"
#: The partition of rows folded from all batches before.
FOLDED = -1


def write_batch_rows(rows: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Rows as the partition of their batch; written again, they replace it."""
    named = rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BATCH, *partition_by).parquet(path)


def batch_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches with their `batch_id`; none where nothing was written yet."""
    whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


class UpsertTable:
    """Rows keyed by `keys`, newest `version` first; `deleted`, if given, marks tombstones."""

    def __init__(
        self, path: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str], deleted: str | None = None
    ) -> None:
        self.path, self.schema = path, schema
        self.keys, self.version, self.deleted = list(keys), list(version), deleted

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`. One row per key leaves each batch."""
        write_batch_rows(latest_per_key(batch.select(*self.schema.names), self.keys, self.version), self.path, batch_id)

    def log(self, spark: SparkSession) -> DataFrame:
        return batch_rows(spark, self.path, self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """Current rows; later batches win ties."""
        now = self._newest(spark).drop(BATCH)
        return now.filter(~F.col(self.deleted)) if self.deleted else now

    def _newest(self, spark: SparkSession) -> DataFrame:
        return latest_per_key(self.log(spark), self.keys, [*self.version, BATCH])

    def compact(self, spark: SparkSession, path: str) -> UpsertTable:
        """The current rows as a table of one batch at `path`. Tombstones stay, so that an old version written later does not come back."""
        write_batch_rows(self._newest(spark).drop(BATCH), path, FOLDED)
        return UpsertTable(path, self.schema, self.keys, self.version, self.deleted)


class DimensionStore:
    """All configured dimension tables in one folder tree, a partition per batch and target table.

    Rows arrive as (sink_table, sink_pk, data map, version): one job writes every table of a
    micro-batch, however many there are. A table's columns come from its config row on read.
    """

    SCHEMA = T.StructType(
        [
            T.StructField("pk", T.StringType()),
            T.StructField("data", T.MapType(T.StringType(), T.StringType())),
            T.StructField("version", T.LongType()),
            T.StructField("arrival", T.LongType()),
            T.StructField("sink_table", T.StringType()),
        ]
    )

    def __init__(self, path: str) -> None:
        self.path = path

    def write_batch(self, routed: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`, on the output of `route_dimensions` with `ts` and `xid`/`xoffset` kept."""
        rows = routed.select(
            "sink_table",
            F.col("data")[F.col("sink_pk")].alias("pk"),
            "data",
            F.col("ts").alias("version"),
            F.coalesce("xoffset", F.lit(0)).alias("arrival"),
        )
        newest = rows.groupBy("sink_table", "pk").agg(
            F.max_by(F.struct("data", "version", "arrival"), F.struct("version", "arrival")).alias("r")
        )
        self._write(newest.select("sink_table", "pk", "r.*"), self.path, batch_id)

    def _write(self, rows: DataFrame, path: str, batch_id: int) -> None:
        write_batch_rows(rows.hint("rebalance", F.col("sink_table")), path, batch_id, ["sink_table"])

    def compact(self, spark: SparkSession, path: str) -> DimensionStore:
        """The newest row per table and key as a store of one batch at `path`."""
        newest = latest_per_key(batch_rows(spark, self.path, self.SCHEMA), ["sink_table", "pk"], ["version", "arrival", BATCH])
        self._write(newest.drop(BATCH), path, FOLDED)
        return DimensionStore(path)

    def read(self, spark: SparkSession, config_row) -> DataFrame:
        """Current rows of one table, all text; NULL stays NULL. Other tables' partitions are not read."""
        rows = batch_rows(spark, self.path, self.SCHEMA).filter(F.col("sink_table") == config_row["sink_table"])
        now = latest_per_key(rows, ["pk"], ["version", "arrival", BATCH])
        return now.select(*(F.col("data")[c].alias(c) for c in dim_schema(config_row).names))
