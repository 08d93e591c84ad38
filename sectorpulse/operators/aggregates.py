"""Counters over news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions import times
from sectorpulse.operators.filters import of_today, published
from sectorpulse.operators.score import ANALYSIS
from sectorpulse.rules.defaults import OTHER_GROUP
from sectorpulse.schema import NONE_LABEL, ROW_ID, is_event

SENTIMENTS = ("positive", "neutral", "negative")


def _sentiment_columns() -> list[Column]:
    sentiment = F.col(ANALYSIS)["sentiment"]
    return [F.count_if(sentiment == s).alias(s) for s in SENTIMENTS]


def sentiment_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows and rows per sentiment, zeros kept; over everything or per group."""
    counts = [F.count(F.lit(1)).alias("total"), *_sentiment_columns()]
    return df.groupBy(*by).agg(*counts)


def today_summary(df: DataFrame, selected_sectors: list[str], as_of) -> DataFrame:
    """Counts over today's rows of the selected sectors and of all event news."""
    scope = is_event() | F.col("sector").isin(list(selected_sectors))
    return sentiment_counts(of_today(df, as_of).filter(scope))


def metadata(df: DataFrame) -> DataFrame:
    """Row count, latest fetch time (UTC, ISO) and latest publish time, or the none label."""
    fetched = F.max(times.fetched_ts(F.col("fetched_at")))
    published_at = F.max(published())
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(
            F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NONE_LABEL)
        ).alias("latest_fetched_at"),
        F.coalesce(F.date_format(published_at, times.PRINT_FORMAT), F.lit(NONE_LABEL)).alias(
            "latest_publish_time"
        ),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Changes whenever the table does: latest fetch time, row count, sum of row hashes.

    A sum counts equal rows as often as they occur, and covers every column but the row id.
    """
    columns = [c for c in sorted(df.columns) if c != ROW_ID]
    return df.agg(
        F.coalesce(F.max("fetched_at"), F.lit("")).alias("latest_fetched_at"),
        F.count(F.lit(1)).alias("total"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("content_hash"),
    )


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source") != "").select("source").distinct().orderBy("source")


def change_counts(**frames: DataFrame) -> DataFrame:
    """Row counts of several frames as one row, one column per name."""
    tagged = [f.select(F.lit(name).alias("frame")) for name, f in frames.items()]
    union = tagged[0]
    for frame in tagged[1:]:
        union = union.unionAll(frame)
    return union.agg(*[F.count_if(F.col("frame") == n).alias(n) for n in frames])


def with_group(sectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Sectors with their group; those in none fall under the remainder.

    The group table is configuration, never data-sized.
    """
    return sectors.join(F.broadcast(groups), "sector", "left").withColumn(
        "sector_group", F.coalesce("sector_group", F.lit(OTHER_GROUP))
    )


def group_rollup(sectors: DataFrame, groups: DataFrame, selected: list[str]) -> DataFrame:
    """Sectors per group and how many of them are selected."""
    chosen = F.col("sector").isin(list(selected)) if selected else F.lit(False)
    return (
        with_group(sectors, groups)
        .groupBy("sector_group")
        .agg(F.count(F.lit(1)).alias("sectors"), F.count_if(chosen).alias("selected"))
    )
