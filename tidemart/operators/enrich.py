"""Dictionary and dimension enrichment.

No join here carries a broadcast hint: Catalyst broadcasts a side only while its measured size is
below `spark.sql.autoBroadcastJoinThreshold`, re-checks it at run time, and otherwise shuffles both
sides and splits skewed partitions. A dimension may thus outgrow memory without a change of code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def enrich(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    mapping: Mapping[str, str],
    dim_key: str = "id",
    how: str = "left",
) -> DataFrame:
    """Add `mapping` (dimension column -> output column); a missing row leaves NULLs."""
    side = dim.select(
        F.col(dim_key).alias("__dim_key"), *(F.col(src).alias(out) for src, out in mapping.items())
    )
    return df.join(side, F.col(key) == F.col("__dim_key"), how).drop("__dim_key")


def lookup(
    df: DataFrame,
    dictionary: DataFrame,
    code_col: str,
    name_col: str,
    how: str = "inner",
    dic_code: str = "dic_code",
    dic_name: str = "dic_name",
) -> DataFrame:
    """Name of a code; the inner default drops rows whose code is unknown."""
    return enrich(df, dictionary, code_col, {dic_name: name_col}, dic_code, how)


def flatten_catalog(
    sku: DataFrame, spu: DataFrame, trademark: DataFrame,
    category3: DataFrame, category2: DataFrame, category1: DataFrame,
) -> DataFrame:
    """The product snowflake as one row per sku with ids and names of every level."""
    flat = sku.select(F.col("id").alias("sku_id"), "spu_id", "category3_id", F.col("tm_id").alias("trademark_id"))
    return add_catalog_names(flat, spu, trademark, category3, category2, category1)


def add_catalog_keys(df: DataFrame, sku: DataFrame, key: str = "sku_id") -> DataFrame:
    """Grouping keys of a sku, wanted before an aggregate."""
    return enrich(df, sku, key, {"spu_id": "spu_id", "category3_id": "category3_id", "tm_id": "trademark_id"})


def add_catalog_names(
    df: DataFrame, spu: DataFrame | None, trademark: DataFrame,
    category3: DataFrame, category2: DataFrame, category1: DataFrame,
) -> DataFrame:
    """Names and parent levels, wanted after an aggregate when fewer rows are left.

    The three category levels fold into one small table first, so the fact side joins once for all.
    """
    tree = category3.select(
        F.col("id").alias("__c3"), F.col("name").alias("category3_name"), "category2_id"
    )
    tree = enrich(tree, category2, "category2_id", {"name": "category2_name", "category1_id": "category1_id"})
    tree = enrich(tree, category1, "category1_id", {"name": "category1_name"})
    if spu is not None:
        df = enrich(df, spu, "spu_id", {"spu_name": "spu_name"})
    df = enrich(df, trademark, "trademark_id", {"tm_name": "trademark_name"})
    return df.join(tree, F.col("category3_id") == F.col("__c3"), "left").drop("__c3")
