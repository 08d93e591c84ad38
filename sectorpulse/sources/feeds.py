"""Flash feeds: whole streams of short items, matched against the keywords locally."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions.ids import stream_link
from sectorpulse.functions.text import fold, fold_word, let
from sectorpulse.operators.score import words_in
from sectorpulse.rules import defaults
from sectorpulse.sources.search import CONTENT_NAMES, TIME_NAMES, TITLE_NAMES, cleaned

# A feed's date column, and how much content stands in for a missing title.
DATE_NAMES = ("发布日期",)
TITLE_CHARS = 40


def feed_rows(df: DataFrame, source: Column, base_link: Column) -> DataFrame:
    """Feed items under the news names, with a synthetic link and no keyword yet."""
    content, title = cleaned(df, CONTENT_NAMES), cleaned(df, TITLE_NAMES)
    date, time = cleaned(df, DATE_NAMES), cleaned(df, TIME_NAMES)
    base = df.select(
        *[F.col(c) for c in df.columns if c == "row_id"],
        source.alias("source"),
        base_link.alias("_base"),
        title.alias("_title"),
        content.alias("content"),
        date.alias("_date"),
        time.alias("_time"),
    )
    shown = F.coalesce(
        F.nullif(F.col("_title"), F.lit("")), F.substring("content", 1, TITLE_CHARS)
    )
    dated = (F.col("_date") != "") & ~F.contains(F.col("_time"), F.col("_date"))
    when = F.when(dated, F.trim(F.concat_ws(" ", "_date", "_time"))).otherwise(F.col("_time"))
    named = base.withColumns({"title": shown, "publish_time": when}).filter(F.col("title") != "")
    return named.select(
        *[F.col(c) for c in df.columns if c == "row_id"],
        "title",
        "source",
        "publish_time",
        stream_link(F.col("_base"), F.col("title"), F.col("publish_time")).alias("link"),
        F.lit("").alias("keyword"),
        "content",
    )


def union_feeds(frames: dict[str, DataFrame]) -> DataFrame:
    """Several feeds as one table; known feed names get their source name and list page."""
    parts = []
    for name, frame in frames.items():
        source, base = defaults.FEEDS.get(name, (name, f"feed://{name}"))
        parts.append(feed_rows(frame, F.lit(source), F.lit(base)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def match_keywords(df: DataFrame, keywords: list[str]) -> DataFrame:
    """One row per (row, keyword its title or content contains); literal and case-folded.

    Keywords are configuration. Each row is expanded where it stands: no join, no shuffle.
    """
    words = [w for w in dict.fromkeys(keywords) if w]
    # A separator no keyword contains keeps matches inside one field.
    text = fold(F.concat(F.col("title"), F.lit("\x00"), F.col("content")))
    folded = list(dict.fromkeys(fold_word(w) for w in words))
    found = let(text, lambda t: words_in(t, folded))
    spelled: dict[str, list[str]] = {}
    for word in words:
        spelled.setdefault(fold_word(word), []).append(word)
    spellings = F.from_json(
        F.lit(json.dumps(spelled, ensure_ascii=False)), "map<string,array<string>>"
    )
    originals = F.flatten(F.transform(found, lambda w: F.element_at(spellings, w)))
    return df.withColumn("keyword", F.explode(originals))
