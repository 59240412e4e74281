"""Application log records: fan-out by kind and the page filters of the traffic jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.operators.visitors import repair_is_new
from tidemart.schemas import LOG
from tidemart.sources.text import OPEN

DETAIL_PAGES = ("home", "good_detail")


def repair_visitors(logs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """`common.is_new` corrected against each device's first day; records without a device stay as sent."""
    flat = (
        logs.withColumn("__mid", F.coalesce("common.mid", F.lit("")))
        .withColumn("__flag", F.when(F.col("common.mid").isNotNull(), F.col("common.is_new")))
        .withColumn("__ts", F.timestamp_millis("ts"))
    )
    return with_flag(repair_is_new(flat, "__mid", "__ts", "__flag", order), "__flag").select(*logs.columns)


def with_flag(logs: DataFrame, flag: str) -> DataFrame:
    """Put a repaired flag back into `common`."""
    fixed = F.col("common").withField("is_new", F.coalesce(F.col(flag), F.col("common.is_new")))
    return logs.withColumn("common", F.when(F.col("common").isNotNull(), fixed))


def split_log(logs: DataFrame) -> dict[str, DataFrame]:
    """Five record kinds over one parsed frame.

    An `err` sends the whole record to *error* and processing goes on. A `start` record goes to
    *start* without its error and nowhere else. Other records give one row per display and per
    action, each with the page, the device and the page's own time, and a *page* row. Columns
    beyond the log layout, such as a topic offset, stay on every row.
    """
    extra = [c for c in logs.columns if c not in LOG.names]
    started = F.col("start").isNotNull()
    rest = logs.filter(~started)

    def items(field: str) -> DataFrame:
        one = rest.select(F.explode(field).alias("__i"), "common", "page", "ts", *extra)
        names = [n for n in logs.schema[field].dataType.elementType.names if n != "ts"]
        return one.select(*(F.col("__i")[n].alias(n) for n in names), "common", "page", "ts", *extra)

    return {
        "error": logs.filter(F.col("err").isNotNull()),
        "start": logs.filter(started).select("common", "start", "ts", *extra),
        "display": items("displays"),
        "action": items("actions"),
        "page": rest.select("common", "page", "ts", *extra),
    }


def fan_out(logs: DataFrame) -> DataFrame:
    """All record kinds of `split_log` in one pass, as (`record`, JSON `value`).

    One write partitioned by `record` then serves every kind from a single scan. Fields beyond the layout, where
    `parse_logs` kept them, stand where they stood: those of the device, the page and the item in every record that
    has these, those at the top in whole records.
    """
    kept = OPEN in logs.columns
    extra = (lambda name: F.col(OPEN)[name]) if kept else (lambda name: None)
    if kept:
        # Made whole once a record, behind a generator that nothing is pushed through, and not in each of its outputs.
        fields = {c: F.col(c) for c in logs.columns} | {c: _merged_object(c, extra(c)) for c in ("common", "page")}
        logs = logs.select(F.inline(F.array(F.struct(*(value.alias(c) for c, value in fields.items())))))
    common, page, top = F.col("common"), F.col("page"), extra("top")

    def tagged(kind: str, row: Column, more: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("record"), _merged(F.to_json(row), more).alias("value"))

    def items(kind: str, field: str) -> Column:
        names = [n for n in logs.schema[field].dataType.elementType.names if n != "ts"]

        def one(i: Column, at: Column) -> Column:
            more = F.get(extra(field), at) if kept else None
            return tagged(kind, F.struct(*(i[n].alias(n) for n in names), common, page, "ts"), more)

        return F.when(~started, F.transform(field, one))

    started = F.col("start").isNotNull()
    objects = {"common": common, "page": page, "start": _raw_object("start"), "err": _raw_object("err")}
    if kept:
        objects |= {n: _merged_list(n, extra(n)) for n in ("displays", "actions")}
    whole = F.struct(*(objects.get(c, F.col(c)) for c in LOG.names))
    singles = F.array(
        F.when(F.col("err").isNotNull(), tagged("error", whole, top)),
        F.when(started, tagged("start", F.struct(common, _raw_object("start"), "ts"), top)),
        F.when(~started, tagged("page", F.struct(common, page, "ts"), top)),
    )
    none = F.array().cast(singles_type := "array<struct<record:string,value:string>>")
    parts = [F.coalesce(p.cast(singles_type), none) for p in (items("display", "displays"), items("action", "actions"))]
    every = F.concat(F.array_compact(singles).cast(singles_type), *parts)
    return logs.select(F.explode(every).alias("__o")).select("__o.*")


def _merged(text: Column, more: Column | None) -> Column:
    """JSON text of an object with the entries of a map behind its own."""
    if more is None:
        return text
    inner = F.substr(F.to_json(more), F.lit(2))

    def joined(own: Column) -> Column:
        both = F.when(own == "{}", F.concat(F.lit("{"), inner)).otherwise(F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(","), inner))
        return F.when(more.isNotNull(), both).otherwise(own)

    # The text is worked out once as a lambda's argument.
    return F.transform(F.array(text), joined)[0]


def _merged_object(name: str, more: Column) -> Column:
    return F.try_parse_json(_merged(F.to_json(F.col(name)), more)).alias(name)


def _merged_list(name: str, more: Column) -> Column:
    return F.transform(name, lambda i, at: F.try_parse_json(_merged(F.to_json(i), F.get(more, at)))).alias(name)


def _raw_object(name: str) -> Column:
    """Raw JSON text as a value again, so that it is not written as an escaped string."""
    return F.try_parse_json(name).alias(name)


def entered() -> Column:
    """A page without a predecessor opens a session."""
    return F.col("page.last_page_id").isNull()


def entry_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(entered())


def pages_in(pages: DataFrame, ids: tuple[str, ...] = DETAIL_PAGES) -> DataFrame:
    return pages.filter(F.col("page.page_id").isin(list(ids)))


def logins(pages: DataFrame) -> DataFrame:
    """A known user on the login page or at the start of a session."""
    return pages.filter(F.col("common.uid").isNotNull() & ((F.col("page.page_id") == "login") | entered()))


def search_keywords(pages: DataFrame) -> DataFrame:
    return pages.filter(
        (F.col("page.last_page_id") == "search")
        & (F.col("page.item_type") == "keyword")
        & F.col("page.item").isNotNull()
    )
