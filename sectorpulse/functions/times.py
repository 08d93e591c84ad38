"""Timestamps. Publish times are wall times in UTC+8; ``as_of`` is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from sectorpulse.schema import NONE_LABEL

# Accepted and printed formats.
SLASH_FORMAT = "yyyy/MM/dd HH:mm:ss"
PRINT_FORMAT = "yyyy-MM-dd HH:mm:ss"
UTC8 = "+08:00"


def publish_ts(column: Column) -> Column:
    """Wall time of a publish text, NULL when it cannot be read; never depends on other rows."""
    text = F.trim(column)
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        F.try_to_timestamp(text, F.lit(SLASH_FORMAT)).cast("timestamp_ntz"),
    )


def fetched_ts(column: Column) -> Column:
    """Fetch time as UTC wall time; text without a zone is read as UTC."""
    return F.trim(column).try_cast("timestamp").cast("timestamp_ntz")


def as_of_ts(as_of: str | datetime) -> Column:
    text = as_of.strftime("%Y-%m-%d %H:%M:%S") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def week_start(ts: Column) -> Column:
    """Monday 00:00."""
    return F.date_trunc("WEEK", F.to_date(ts)).cast("timestamp_ntz")


def days_before(ts: Column, days: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(days)} DAYS")


def hours_before(ts: Column, hours: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(hours)} HOURS")


def format_utc8(column: Column, suffix: bool = True) -> Column:
    """Stored UTC text shown in UTC+8; unreadable text passes through, blank becomes the none label."""
    text = F.trim(F.coalesce(column, F.lit("")))
    instant = F.coalesce(
        text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit(SLASH_FORMAT))
    )
    shown = F.date_format(F.from_utc_timestamp(instant, UTC8), PRINT_FORMAT)
    if suffix:
        shown = F.concat(shown, F.lit(" UTC+8"))
    readable = (text != "") & (text != NONE_LABEL) & text.rlike(r"^\d{4}[-/]")
    return F.when(readable, F.coalesce(shown, text)).otherwise(
        F.coalesce(F.nullif(text, F.lit("")), F.lit(NONE_LABEL))
    )
