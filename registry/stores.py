"""Keyed tables written in batches, with a repeat, late versions, tombstones and a compaction, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from registry import Tables, feeds, query
from registry.dwd import _config
from tidemart.operators.sets import union_all
from tidemart.plans import dim
from tidemart.session import work_dir
from tidemart.sources.connectors import stream_files
from tidemart.streaming.sinks import drain
from tidemart.streaming.upsert import DimensionStore, UpsertTable, batch_rows

_ORDER = T.StructType(
    [
        T.StructField("o_custkey", T.LongType()), T.StructField("o_orderkey", T.LongType()), T.StructField("status", T.StringType()),
        T.StructField("version", T.LongType()), T.StructField("gone", T.BooleanType()),
    ]
)


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus AS status, epoch_us(o_orderdate) AS version, o_orderstatus = 'P' AS gone FROM orders),
n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderkey, status FROM n WHERE NOT gone
""")
def upsert_orders(t: Tables) -> DataFrame:
    """Each customer's newest order; a pending one is a tombstone.

    A stream writes the batches, in no order of time. It is stopped between them and goes on from its checkpoint; one
    batch is written twice, and the first ones are folded before the last.
    """
    folder = work_dir(t.spark, "upsert-orders")
    table = UpsertTable(f"{folder}/rows", _ORDER, ["o_custkey"], ["version", "o_orderkey"], "gone")
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("version"), (F.col("o_orderstatus") == "P").alias("gone"),
    )
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(4))

    def run(store: UpsertTable, *parts: int) -> None:
        for i in parts:
            rows.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        source = stream_files(t.spark, f"{folder}/in", _ORDER)
        drain(source.writeStream.foreachBatch(store.write_batch).option("checkpointLocation", f"{folder}/checkpoint"))

    run(table, 2, 0)
    run(table, 1)
    table.write_batch(rows.filter(part == 1), 1)
    table = table.compact(t.spark, f"{folder}/folded")
    run(table, 3)
    return table.read(t.spark).select("o_custkey", "o_orderkey", "status")


@query("""
SELECT 'dim_customer' AS sink_table, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer
UNION ALL SELECT 'dim_supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
UNION ALL SELECT 'dirty', NULL, CAST(count(*) AS VARCHAR) FROM benchmark
""")
def dimension_store(t: Tables) -> DataFrame:
    """Two dimension tables kept by a stream that is stopped and goes on, one of them fed twice, and the text that was no event."""
    config = t.region.select(
        F.explode(
            F.array(
                *(
                    F.to_json(F.struct(_config(source, target, "id,name").alias("after"), F.col("r_regionkey").alias("ts_ms")))
                    for source, target in (("customer", "dim_customer"), ("supplier", "dim_supplier"))
                )
            )
        ).alias("value")
    )
    folder = work_dir(t.spark, "dimension-store")
    config.write.text(f"{folder}/config")
    store, refused = DimensionStore(f"{folder}/store"), f"{folder}/dirty"
    customers = feeds.table_text(t.customer, "customer", {"id": "c_custkey", "name": "c_name"})
    suppliers = feeds.table_text(t.supplier, "supplier", {"id": "s_suppkey", "name": "s_name"})
    value = T.StructType([T.StructField("value", T.StringType())])
    # Each step stops the stream; the next goes on from its checkpoint. The suppliers come twice.
    for raw in (union_all(customers, t.benchmark.select(F.col("text").alias("value"))), suppliers, suppliers):
        raw.write.mode("append").parquet(f"{folder}/in")
        stream = stream_files(t.spark, f"{folder}/in", value)
        drain(dim.maintain_dimensions(t.spark, stream, f"{folder}/config", store, f"{folder}/checkpoint", refused))
    store = store.compact(t.spark, f"{folder}/folded")
    tables = [
        store.read(t.spark, {"sink_table": name, "sink_columns": "id,name", "sink_pk": ""}).select(F.lit(name).alias("sink_table"), "id", "name")
        for name in ("dim_customer", "dim_supplier")
    ]
    dirty = batch_rows(t.spark, refused, value).agg(F.count("*").cast("string").alias("name"))
    return union_all(*tables, dirty.select(F.lit("dirty").alias("sink_table"), F.lit(None).cast("string").alias("id"), "name"))
