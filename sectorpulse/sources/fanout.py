"""From per-keyword results to per-sector and per-category rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.rules.tables import RuleSet, Sector

NEWS_FIELDS = ("title", "source", "publish_time", "link", "keyword", "content")


def choose_source(
    primary: DataFrame, fallback: DataFrame, feeds: DataFrame, status: DataFrame
) -> DataFrame:
    """Per keyword: primary rows if that search succeeded (even empty), else fallback rows, plus
    all feed matches. ``status`` is (keyword, source 'primary'|'fallback', ok), one line per
    keyword and source of the run's keyword list."""
    worked = F.broadcast(
        status.filter((F.col("source") == "primary") & F.col("ok")).select("keyword").distinct()
    )
    return (
        primary.join(worked, "keyword", "left_semi")
        .unionByName(fallback.join(worked, "keyword", "left_anti"))
        .unionByName(feeds)
    )


def failed_keywords(status: DataFrame, feeds: DataFrame) -> DataFrame:
    """Keywords for which no search succeeded and no feed had a match."""
    outcome = status.groupBy("keyword").agg(F.bool_or("ok").alias("any_ok"))
    failed = outcome.filter(~F.col("any_ok")).select("keyword")
    return failed.join(feeds.select("keyword").distinct(), "keyword", "left_anti")


def keyword_table(spark, sectors: list[Sector], events: RuleSet) -> DataFrame:
    """(scope, name, name_pos, keyword, keyword_pos): who asks for which keyword."""
    rows = [
        ("sector", s.name, i, k, j) for i, s in enumerate(sectors) for j, k in enumerate(s.keywords)
    ]
    rows += [
        ("event", name, i, k, j)
        for i, (name, words) in enumerate(events.keywords().items())
        for j, k in enumerate(words)
    ]
    return spark.createDataFrame(
        rows, "scope string, name string, name_pos int, keyword string, keyword_pos int"
    )


def fan_out(raw: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per (asking sector or category, found row), from configuration-sized ``asked``."""
    return raw.join(F.broadcast(asked), "keyword")


def outcomes(asked: DataFrame, failed: DataFrame) -> DataFrame:
    """Per asking name its keywords, how many failed, and 'ok', 'warning' or 'error' (all failed)."""
    marked = asked.join(failed.select("keyword").distinct().withColumn("failed", F.lit(True)), "keyword", "left")
    bad = F.coalesce(F.col("failed"), F.lit(False))
    counted = marked.groupBy("scope", "name").agg(
        F.count(F.lit(1)).alias("keywords"), F.count_if(bad).alias("failed")
    )
    outcome = F.when(F.col("failed") == 0, "ok").when(F.col("failed") == F.col("keywords"), "error").otherwise("warning")
    return counted.withColumn("outcome", outcome)


def keyword_errors(asked: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed keywords per asking name, and whether all of its keywords failed."""
    troubled = outcomes(asked, failed).filter(F.col("failed") > 0)
    return troubled.select("scope", "name", "keywords", "failed", (F.col("outcome") == "error").alias("nothing_worked"))
