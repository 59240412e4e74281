"""Record layouts of the warehouse layers."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


COMMON = T.StructType(_strings("ar", "ba", "ch", "is_new", "md", "mid", "os", "uid", "vc"))
PAGE = T.StructType(
    [T.StructField("during_time", T.LongType())]
    + _strings("item", "item_type", "last_page_id", "page_id", "source_type")
)
ACTION = T.StructType(_strings("action_id", "item", "item_type") + [T.StructField("ts", T.LongType())])
DISPLAY = T.StructType(
    _strings("display_type", "item", "item_type")
    + [T.StructField("order", T.IntegerType()), T.StructField("pos_id", T.IntegerType())]
)

# `start` and `err` are open objects: the JSON reader hands a string field the raw text.
LOG = T.StructType(
    [
        T.StructField("common", COMMON),
        T.StructField("page", PAGE),
        T.StructField("actions", T.ArrayType(ACTION)),
        T.StructField("displays", T.ArrayType(DISPLAY)),
        *_strings("start", "err"),
        T.StructField("ts", T.LongType()),
    ]
)

CHANGE = T.StructType(
    [
        *_strings("database", "table", "type"),
        T.StructField("ts", T.LongType()),
        T.StructField("xid", T.LongType()),
        T.StructField("xoffset", T.LongType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("old", T.MapType(T.StringType(), T.StringType())),
    ]
)

DIM_CONFIG = T.StructType(_strings("source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend"))
# A change-capture connector's record of one config row.
CONFIG_CHANGE = T.StructType(
    [
        T.StructField("before", DIM_CONFIG),
        T.StructField("after", DIM_CONFIG),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)

DICTIONARY = T.StructType(
    _strings("dic_code", "dic_name", "parent_code")
    + [T.StructField("create_time", T.TimestampType()), T.StructField("operate_time", T.TimestampType())]
)

ORDER_LINE = T.StructType(
    _strings(
        "id", "order_id", "user_id", "order_status", "sku_id", "sku_name", "province_id",
        "activity_id", "activity_rule_id", "coupon_id", "date_id", "create_time",
        "operate_date_id", "operate_time", "source_id", "source_type", "source_type_name",
        "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount",
        "split_total_amount", "type",
    )
    + [
        T.StructField("old", T.MapType(T.StringType(), T.StringType())),
        T.StructField("row_op_ts", T.TimestampType()),
    ]
)
