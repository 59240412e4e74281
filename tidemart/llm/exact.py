"""Operator 4, exact dedup: a stream of digests against keyed state on disk that never expires.

1. Each text is normalised (A-Z lower-cased; null counts as empty) and its digest written with a stable
   identifier - document id, then a row number - and a content locator, the file the text was read from.
2. The digests are streamed. State per digest, kept by RocksDB and its checkpoint, is the number of texts and
   the identifier and locator of the row that stays. Spark combines a batch's copies before the shuffle, so a
   group of any size reaches its state as one row per task.
3. Hits, digests seen more than once, are checked on full bytes: their texts are grouped by digest and bytes.
   A digest with different bytes below it (a collision) is settled by bytes instead.

Of equal texts the row with the largest id stays; of rows that also share the id, one stays. A null id is
smaller than any other. An empty table gives no rows. Other columns are not read. Rows are stored with their number once,
and every later step reads it from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemart.llm.session import lower_ascii, numbered, prepared, scratch, stored, table

FILES_PER_BATCH = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _streamed_state(spark: SparkSession, prints: DataFrame, folder: str, files: int) -> DataFrame:
    """Digest, number of texts, and the row that stays, as the state store holds them when the stream is drained."""
    rows = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/prints")
    best = F.max(F.struct("id", "seq", "locator"))
    state = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
    query = (
        state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start()
    )
    query.awaitTermination()
    held = spark.read.format("statestore").load(f"{folder}/state")
    best, n = (held.schema["value"].dataType[i].name for i in range(2))
    return held.select(F.col("key.digest").alias("digest"), F.col("value")[best].alias("best"), F.col("value")[n].alias("n"))


def dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files: int = FILES_PER_BATCH,
) -> DataFrame:
    """Per row: row number, id, keep_id, group_size, kept, text_sha256, and the locators of the row and of the one that stays."""
    prepared(docs.sparkSession)
    return _dedup(numbered(docs.select(id, text)), id, text, digest, files)


def _dedup(rows: DataFrame, id: str, text: str, digest: Callable[[Column], Column] = sha256, files: int = FILES_PER_BATCH) -> DataFrame:
    """The answer for rows stored with their numbers."""
    spark = prepared(rows.sparkSession)
    folder = scratch(spark, "exact-dedup")
    row = F.col("row")
    source = rows.select(row[id].cast("long").alias("id"), lower_ascii(row[text]).alias("norm"), "seq", F.col("file").alias("locator"))
    prints = source.select("id", "seq", "locator", digest(F.col("norm")).alias("digest"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    prints.write.parquet(f"{folder}/prints")
    prints = spark.read.schema(prints.schema).parquet(f"{folder}/prints")
    hits = stored(_streamed_state(spark, prints.drop("text_sha256"), folder, files).filter("n > 1"), "exact-hits")

    keyed = source.select("id", "norm", digest(F.col("norm")).alias("digest"))
    classes = keyed.join(hits.filter("n > 1").select("digest"), "digest").groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clashes = stored(classes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "exact-clashes")

    rows = prints.join(hits, "digest", "left")
    plain = rows.join(clashes, "digest", "left_anti") if clashes.take(1) else rows
    hit = F.col("n").isNotNull()
    out = plain.select(
        "seq", F.col("id").alias("doc_id"), F.when(hit, F.col("best.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(hit, F.col("best.seq") == F.col("seq")).otherwise(F.lit(True)).alias("kept"), "text_sha256",
        "locator", F.when(hit, F.col("best.locator")).otherwise(F.col("locator")).alias("keep_locator"),
    )
    return out.unionByName(_by_bytes(source, digest, clashes)) if clashes.take(1) else out


def _by_bytes(source: DataFrame, digest: Callable[[Column], Column], clashes: DataFrame) -> DataFrame:
    """The answer for digests that different texts share."""
    rows = source.withColumn("digest", digest(F.col("norm"))).join(clashes, "digest")
    group = Window.partitionBy("norm")
    ranked = group.orderBy(F.col("id").desc_nulls_last(), F.col("seq").desc())
    return rows.select(
        "seq", F.col("id").alias("doc_id"), F.max("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        "locator", F.first("locator").over(ranked).alias("keep_locator"),
    )


def kept_rows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, columns unchanged, without their copies."""
    prepared(docs.sparkSession)
    rows = numbered(docs)
    gone = stored(_dedup(rows, id, text).filter(~F.col("kept")).select("seq"), "exact-gone")
    return rows.join(gone, "seq", "left_anti").select("row.*")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL4 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
