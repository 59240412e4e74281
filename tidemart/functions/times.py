"""Time columns: epoch milliseconds in logs, `yyyy-MM-dd HH:mm:ss` strings in business rows.

All of them read and print in `spark.sql.session.timeZone`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FULL = "yyyy-MM-dd HH:mm:ss"
DAY = "yyyy-MM-dd"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def from_millis(ms: Column | str) -> Column:
    return F.timestamp_millis(_c(ms).cast("bigint"))


def from_millis_floor(ms: Column | str) -> Column:
    """Epoch milliseconds cut to whole seconds, as the keyword window reads them."""
    return F.timestamp_seconds(F.floor(_c(ms).cast("bigint") / F.lit(1000)))


def parse_time(text: Column | str) -> Column:
    """A full time string as a timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(_c(text), F.lit(FULL))


def to_millis(text: Column | str, full: bool = True) -> Column:
    text = _c(text)
    return F.unix_millis(parse_time(text if full else F.concat(text, F.lit(" 00:00:00"))))


def millis_to_day(ms: Column | str) -> Column:
    return F.date_format(from_millis(ms), DAY)


def millis_to_full(ms: Column | str) -> Column:
    return F.date_format(from_millis(ms), FULL)


def full(ts: Column | str) -> Column:
    return F.date_format(_c(ts), FULL)


def date_id(text: Column | str) -> Column:
    return F.date_format(parse_time(text), DAY)


def date_prefix(text: Column | str) -> Column:
    return F.substring_index(_c(text), " ", 1)


def day_number(ts: Column | str) -> Column:
    """The day as an integer yyyyMMdd."""
    return F.date_format(_c(ts), "yyyyMMdd").cast("int")


def today_number() -> Column:
    return day_number(F.current_date())


def version_millis() -> Column:
    """Processing time of the micro-batch, the version of a summary row."""
    return F.unix_millis(F.current_timestamp())


def version_seconds() -> Column:
    return F.unix_timestamp()
