"""Row filters over news. Time filters take ``as_of``; none reads a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions import times
from sectorpulse.functions.text import fold, fold_word
from sectorpulse.operators.score import ANALYSIS
from sectorpulse.schema import is_event

# Names of the time ranges.
ALL_TIME, TODAY, THREE_DAYS, THIS_WEEK = "全部", "今天", "近 3 天", "本周"
ALERT_HOURS = 24


#: The partition column of a stored table (``sinks.table``): the date of the publish time.
PUBLISH_DATE = "publish_date"


def published() -> Column:
    return times.publish_ts(F.col("publish_time"))


def dates_from(df: DataFrame, start: Column) -> DataFrame:
    """On a stored table only the partitions of ``start``'s day and later; other frames as they are.

    Dated rows published before that day go; the caller filters by time as well.
    """
    if PUBLISH_DATE not in df.columns:
        return df
    return df.filter(F.col(PUBLISH_DATE) >= F.to_date(start))


def in_time_range(df: DataFrame, time_range: str, as_of) -> DataFrame:
    """Rows of a named range; rows without a readable time only pass the open range."""
    now = times.as_of_ts(as_of)
    starts = {
        TODAY: times.day_start(now),
        THREE_DAYS: times.days_before(now, 3),
        THIS_WEEK: times.week_start(now),
    }
    if time_range not in starts:
        return df
    start = starts[time_range]
    return dates_from(df, start).filter(published() >= start)


def is_today(as_of) -> Column:
    return F.coalesce(
        F.to_date(published()) == F.to_date(times.as_of_ts(as_of)), F.lit(False)
    )


def in_last_hours(as_of, hours: int = ALERT_HOURS) -> Column:
    cutoff = times.hours_before(times.as_of_ts(as_of), hours)
    return F.coalesce(published() >= cutoff, F.lit(False))


def last_day(df: DataFrame, as_of, hours: int = ALERT_HOURS) -> DataFrame:
    """The partitions that ``in_last_hours`` or ``is_today`` can pass."""
    return dates_from(df, times.hours_before(times.as_of_ts(as_of), hours))


def of_today(df: DataFrame, as_of) -> DataFrame:
    """Rows published on the day of ``as_of``."""
    return dates_from(df, times.as_of_ts(as_of)).filter(is_today(as_of))


def search(df: DataFrame, keyword: str = "", sources: list[str] = ()) -> DataFrame:
    """Free-text search (literal, case-folded) and source selection; both optional."""
    found = df
    if keyword:
        searched = ("title", "keyword", "source", "event_category", "related_sectors")
        parts = [F.coalesce(F.col(c), F.lit("")) for c in searched]
        haystack = fold(F.concat_ws(" ", *parts))
        found = found.filter(F.contains(haystack, F.lit(fold_word(keyword.strip()))))
    if sources:
        found = found.filter(F.col("source").isin(list(sources)))
    return found


def of_sectors(df: DataFrame, sectors: list[str]) -> DataFrame:
    return df.filter(F.col("sector").isin(list(sectors)))


def sector_rows(df: DataFrame) -> DataFrame:
    return df.filter(~is_event())


def event_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_event())


def sectors_matching(sectors: DataFrame, query: str) -> DataFrame:
    """Sectors whose name or any keyword contains the query."""
    wanted = fold_word(query.strip())
    if not wanted:
        return sectors
    name = F.contains(fold(F.col("sector")), F.lit(wanted))
    word = F.exists("keywords", lambda k: F.contains(fold(k), F.lit(wanted)))
    return sectors.filter(name | word)


def retained(days: int, as_of) -> Column:
    """What ``prune`` keeps; never NULL."""
    cutoff = times.days_before(times.as_of_ts(as_of), days)
    seen, got = published(), times.fetched_ts(F.col("fetched_at"))
    return F.coalesce((seen >= cutoff) | (seen.isNull() & (got.isNull() | (got >= cutoff))), F.lit(False))


def prune(df: DataFrame, days: int, as_of) -> DataFrame:
    """Retention by publish time, else by fetch time; rows with neither stay."""
    if days <= 0:
        return df
    if PUBLISH_DATE in df.columns:
        day = F.col(PUBLISH_DATE)
        df = df.filter(day.isNull() | (day >= F.to_date(times.days_before(times.as_of_ts(as_of), days))))
    return df.filter(retained(days, as_of))


def push_worthy(df: DataFrame, as_of) -> DataFrame:
    """Recent rows that are policy news or of high impact."""
    record = F.col(ANALYSIS)
    important = (record["category"] == "policy") | (record["impact_level"] == "high")
    return last_day(df, as_of).filter(in_last_hours(as_of) & important)
