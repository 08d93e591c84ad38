"""Joins against what is already known: stored links, pushed links, hot links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions.ids import link_hash
from sectorpulse.functions.text import link_key

#: Rows the alert history is trimmed to when it is kept as a list of bounded length.
HISTORY_LIMIT = 800


def new_links(
    existing: DataFrame,
    fetched: DataFrame,
    keep_fragment: bool = False,
    scope_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Fetched rows whose link is blank or not stored yet, whatever their time or sector.

    ``scope_columns`` compares links only within equal values of those columns. Blank links take
    no part in the shuffle: they are kept without a join.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_link", link_key(F.col("link"), keep_fragment))

    keys = ["_link", *scope_columns]
    known = keyed(existing).filter(F.col("_link") != "").select(*keys).distinct()
    candidates = keyed(fetched)
    blank = candidates.filter(F.col("_link") == "")
    unseen = candidates.filter(F.col("_link") != "").join(known, keys, "left_anti")
    return unseen.unionByName(blank).select(*fetched.columns)


def unpushed(df: DataFrame, history: DataFrame) -> DataFrame:
    """Rows whose link fingerprint is not in the history, whatever its length."""
    pushed = history.select(F.col("link_hash").alias("_hash"))
    marked = df.withColumn("_hash", link_hash(F.col("link")))
    return marked.join(pushed, "_hash", "left_anti").select(*df.columns)


def append_history(history: DataFrame, pushed: DataFrame, limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """History (seq, link_hash) followed by the pushed rows (seq, link).

    Trimmed to the newest ``limit`` rows; with ``None`` nothing is forgotten.
    """
    top = history.agg(F.max("seq")).first()[0]
    added = pushed.select(
        (F.col("seq") + F.lit(0 if top is None else top + 1)).alias("seq"),
        link_hash(F.col("link")).alias("link_hash"),
    )
    both = history.select("seq", "link_hash").unionByName(added)
    return both if limit is None else both.orderBy(F.desc("seq")).limit(limit)


def mark_hot(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Flag rows whose link is in the hot list (a handful of rows)."""
    links = hot.filter(F.col("link") != "").select("link").distinct().withColumn("_hot", F.lit(True))
    marked = df.join(F.broadcast(links), "link", "left")
    return marked.select(*df.columns, F.coalesce("_hot", F.lit(False)).alias("is_hot"))
