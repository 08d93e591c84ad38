"""News de-duplication: greedy keep-first by link, title, content and near-equal title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions import text, times
from sectorpulse.operators.leaders import Selection, select_leaders
from sectorpulse.operators.similar import SAME_STORY
from sectorpulse.schema import ROW_ID, combine, is_event, repair
from sectorpulse.session import cut_lineage


def newest_first() -> list[Column]:
    """Time order of news: readable times first, newest first, then by the raw text."""
    return [times.publish_ts(F.col("publish_time")), F.col("publish_time")]


def news_scope() -> list[Column]:
    """Sector news is compared within its sector, all event news together."""
    return [is_event().cast("string"), F.when(is_event(), "").otherwise(F.col("sector"))]


def news_keys(keep_fragment: bool = False) -> dict[str, Column]:
    """Link and content, of which equal values tell the same story; blank ones tell nothing."""
    return {
        "link": text.link_key(F.col("link"), keep_fragment),
        "content": text.text_key(F.col("content")),
    }


#: Columns of ``with_story_keys``.
STORY_KEYS = {"link": "_link_key", "content": "_content_key", "title": "_title_key"}
_MD5_OF_NOTHING = "d41d8cd98f00b204e9800998ecf8427e"


def with_story_keys(df: DataFrame, keep_fragment: bool = False) -> DataFrame:
    """``df`` with what its rows are compared by, for several selections; contents by their digests."""
    found = news_keys(keep_fragment)
    digest = text.let(F.md5(found["content"]), lambda d: F.when(d == _MD5_OF_NOTHING, "").otherwise(d))
    values = {**found, "content": digest, "title": text.title_key(F.col("title"))}
    return df.withColumns({STORY_KEYS[name]: value for name, value in values.items()})


def select_news(
    df: DataFrame,
    partition_by: list[Column] = (),
    fuzzy: bool = True,
    keep_fragment: bool = False,
    **options,
) -> Selection:
    """Decide for every row whether an earlier kept row already tells its story.

    Rows ``with_story_keys`` are compared by those (and ``keep_fragment`` is theirs).
    """
    if set(STORY_KEYS.values()) <= set(df.columns):
        exact = {name: F.col(STORY_KEYS[name]) for name in ("link", "content")}
        title = F.col(STORY_KEYS["title"])
    else:
        exact = news_keys(keep_fragment)
        title = text.title_key(F.col("title"))
    if not fuzzy:
        exact["title"] = title
    return select_leaders(
        df,
        order_by=newest_first(),
        partition_by=list(partition_by),
        exact=exact,
        title=title if fuzzy else None,
        similarity=SAME_STORY if fuzzy else None,
        **options,
    )


def dedupe(df: DataFrame, partition_by: list[Column] = (), fuzzy: bool = True, **options) -> DataFrame:
    """The kept rows, unchanged (their ``fetched_at`` too)."""
    kept = select_news(df, partition_by, fuzzy, **options).decisions.filter("is_leader")
    return df.join(kept.select(ROW_ID), ROW_ID, "left_semi")


def dedupe_news(df: DataFrame, fuzzy: bool = True, **options) -> DataFrame:
    """De-duplicate a stored table: per sector, and once over all event news."""
    return dedupe(df, news_scope(), fuzzy, **options)


def append_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with row ids after all of ``existing``: on ties the older row goes first."""
    top = existing.agg(F.max(ROW_ID)).first()[0]
    return new.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(0 if top is None else top + 1))


def merge(
    existing: DataFrame, new: DataFrame, fuzzy: bool = True, keep_fragment: bool = False, **options
) -> DataFrame:
    """De-duplicated existing rows joined by new ones that tell something new.

    Row ids of ``new`` must follow those of ``existing`` (see ``append_ids``), which may come ``with_story_keys``.
    """
    # Texts are normalised once for both selections.
    keyed = set(STORY_KEYS.values()) <= set(existing.columns)
    settled = dedupe_news(existing if keyed else cut_lineage(with_story_keys(existing, keep_fragment)), fuzzy, **options)
    # Read twice by the second selection.
    told = with_story_keys(repair(new), keep_fragment)
    both = cut_lineage(combine(settled, told, carry=(ROW_ID, *STORY_KEYS.values())))
    return dedupe_news(both, fuzzy, **options).drop(*STORY_KEYS.values())
