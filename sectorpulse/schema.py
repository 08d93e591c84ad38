"""The one news schema every operator shares.

``row_id`` (long, unique) rides along with the twelve stored text columns: Spark tables have no
row order, so each order-sensitive operator breaks its ties with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and markers of the stored news table.
NEWS_COLUMNS = (
    "news_type",
    "sector",
    "title",
    "source",
    "publish_time",
    "link",
    "keyword",
    "content",
    "event_category",
    "related_sectors",
    "reason",
    "fetched_at",
)
DISPLAY_NAMES = {
    "title": "标题",
    "source": "来源媒体",
    "publish_time": "发布时间",
    "link": "原文链接",
    "keyword": "匹配关键词",
    "content": "新闻内容",
}
SECTOR_NEWS = "sector_news"
EXTERNAL_EVENT = "external_event"
UNMAPPED = "未映射"
NONE_LABEL = "无"

NEWS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in NEWS_COLUMNS])

ROW_ID = "row_id"


def is_event(news_type: Column | str = "news_type") -> Column:
    """True for event rows; every other value of ``news_type`` means sector news."""
    column = F.col(news_type) if isinstance(news_type, str) else news_type
    return column == F.lit(EXTERNAL_EVENT)


def text_or_blank(df: DataFrame, name: str) -> Column:
    """The column as text with NULL as '', or '' when the frame lacks it."""
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def blank_to(column: Column, default: Column) -> Column:
    """``default`` where the text is NULL or ''."""
    return F.coalesce(F.nullif(column, F.lit("")), default)


def repair(df: DataFrame, carry: Sequence[str] = (ROW_ID,)) -> DataFrame:
    """Project any frame onto the news schema; a ``row_id`` column (those of ``carry``) is carried when present."""
    columns = [text_or_blank(df, c).alias(c) for c in NEWS_COLUMNS]
    columns[0] = blank_to(text_or_blank(df, "news_type"), F.lit(SECTOR_NEWS)).alias("news_type")
    carried = [F.col(c) for c in carry if c in df.columns]
    return df.select(*carried, *columns)


def to_display(df: DataFrame) -> DataFrame:
    """Cache shape to display shape: six renamed columns, no ``fetched_at``."""
    news = repair(df)
    return news.select(
        *[F.col(c) for c in news.columns if c == ROW_ID],
        *[F.col(c).alias(DISPLAY_NAMES.get(c, c)) for c in NEWS_COLUMNS if c != "fetched_at"],
    )


def from_display(
    df: DataFrame,
    fetched_at: str,
    sector: str = "",
    news_type: str = SECTOR_NEWS,
    event_category: str = "",
    related_sectors: str = "",
    reason: str = "",
) -> DataFrame:
    """Display shape to cache shape; blank scope columns take the given defaults."""
    defaults = {
        "news_type": news_type,
        "sector": sector,
        "event_category": event_category,
        "related_sectors": related_sectors,
        "reason": reason,
    }
    columns = []
    for name in NEWS_COLUMNS:
        if name == "fetched_at":
            value = F.lit(fetched_at)
        elif name in defaults:
            value = blank_to(text_or_blank(df, name), F.lit(defaults[name]))
        else:
            value = text_or_blank(df, DISPLAY_NAMES[name])
        columns.append(value.alias(name))
    carried = [F.col(ROW_ID)] if ROW_ID in df.columns else []
    return repair(df.select(*carried, *columns))


def combine(*frames: DataFrame, carry: Sequence[str] = (ROW_ID,)) -> DataFrame:
    """Union of repaired frames (missing columns become blank)."""
    repaired = [repair(f, carry) for f in frames]
    if not repaired:
        raise ValueError("combine() needs at least one frame")
    result = repaired[0]
    for frame in repaired[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections use without computing them again.

    Spark moves filters below projections by repeating the projected expression. Values that come
    out of a generator stay where they are, and one row in gives one row out.
    """
    record = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(record)))
