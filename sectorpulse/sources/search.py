"""Keyword-search sources: name-matched frames, API items, raw API responses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorpulse.functions.text import clean_text
from sectorpulse.rules import defaults
from sectorpulse.schema import blank_to

# Names a raw frame may use per role, first match wins.
TITLE_NAMES = ("新闻标题", "标题", "title")
SOURCE_NAMES = ("文章来源", "来源", "媒体", "source")
TIME_NAMES = ("发布时间", "时间", "日期", "publish_time")
LINK_NAMES = ("新闻链接", "链接", "url", "link")
CONTENT_NAMES = ("新闻内容", "内容", "摘要", "content")
ITEM_FIELDS = (
    "title", "新闻标题", "code", "url", "link", "articleUrl", "newsUrl",
    "mediaName", "source", "date", "time", "content", "summary",
)


def pick(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((name for name in names if name in df.columns), None)


def cleaned(df: DataFrame, names: tuple[str, ...], default: str = "") -> Column:
    name = pick(df, names)
    return F.lit(default) if name is None else clean_text(F.col(name).cast("string"))


def search_rows(df: DataFrame, keyword: Column) -> DataFrame:
    """Search results under the news names; rows without title or link are dropped."""
    for role, names in (("title", TITLE_NAMES), ("link", LINK_NAMES)):
        if pick(df, names) is None:
            raise ValueError(f"search frame has no {role} column: {df.columns}")
    rows = df.select(
        *[F.col(c) for c in df.columns if c == "row_id"],
        cleaned(df, TITLE_NAMES).alias("title"),
        cleaned(df, SOURCE_NAMES, defaults.UNKNOWN_SOURCE).alias("source"),
        cleaned(df, TIME_NAMES).alias("publish_time"),
        cleaned(df, LINK_NAMES).alias("link"),
        keyword.alias("keyword"),
        cleaned(df, CONTENT_NAMES).alias("content"),
    )
    return rows.filter((F.col("title") != "") & (F.col("link") != ""))


def item_rows(df: DataFrame, item: str = "item", keyword: str = "keyword") -> DataFrame:
    """API items (a struct of ITEM_FIELDS texts) under the news names."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(item)[n], F.lit("")) for n in names], F.lit(""))

    code = clean_text(F.col(item)["code"])
    by_code = F.when(code != "", F.format_string(defaults.SEARCH_LINK, code)).otherwise("")
    source = F.coalesce(
        F.nullif(first("mediaName", "source"), F.lit("")), F.lit(defaults.SEARCH_SOURCE)
    )
    rows = df.select(
        *[F.col(c) for c in df.columns if c == "row_id"],
        clean_text(first("title", "新闻标题")).alias("title"),
        clean_text(source).alias("source"),
        clean_text(first("date", "time")).alias("publish_time"),
        blank_to(clean_text(first("url", "link", "articleUrl", "newsUrl")), by_code).alias("link"),
        F.col(keyword).alias("keyword"),
        clean_text(first("content", "summary")).alias("content"),
    )
    return rows.filter((F.col("title") != "") & (F.col("link") != ""))


_ITEM = T.StructType([T.StructField(name, T.StringType()) for name in ITEM_FIELDS])
_PARSED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("items", T.ArrayType(_ITEM))])


@F.pandas_udf(_PARSED)
def _items(payloads: pd.Series) -> pd.DataFrame:
    """Outermost objects with a title anywhere in a JSON text, in document order."""

    def as_text(value) -> str:
        return "" if not value else value if isinstance(value, str) else str(value)

    def find(payload: str):
        try:
            stack = [json.loads(payload)]
        except (TypeError, ValueError):
            return False, []
        found = []
        while stack:
            node = stack.pop()
            if isinstance(node, dict) and "title" in node:
                found.append({name: as_text(node.get(name)) for name in ITEM_FIELDS})
            elif isinstance(node, (dict, list)):
                children = list(node.values()) if isinstance(node, dict) else node
                stack.extend(reversed(children))
        return True, found

    return pd.DataFrame([find(p) for p in payloads], columns=["ok", "items"])


def parse_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Raw response texts to (…, ok, items): what lies between the outer brackets, else braces."""
    text = F.trim(F.col(body))
    in_brackets = F.regexp_extract(text, r"(?s)^[^(]*\((.*)\)", 1)
    in_braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    payload = F.when(text.rlike(r"(?s)\(.*\)"), in_brackets).otherwise(in_braces)
    parsed = df.withColumn("_parsed", _items(payload))
    return parsed.select(*df.columns, "_parsed.ok", "_parsed.items")
