"""Merging a batch into a settled table, deciding again only what the batch can change.

A table is settled when no two of its rows tell the same story: what de-duplication returns is, and so is
every part of it. Its rows then never decide each other. A row of the table can only fall to a new row
with a key of it or a similar title, and a new row only to such a row or to another new one. So the rows
in question are the new ones and the stored ones that share a key with, or may resemble, one of them; a
selection among those gives what a selection over everything gives.

Keys are stored columns (``with_keys``), so that finding those rows is one narrow scan of the table, without
a shuffle of its rows and without normalising a stored text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.functions import text
from sectorpulse.operators.dedupe import dedupe_news, news_keys, news_scope, select_news
from sectorpulse.operators.leaders import scoped_key
from sectorpulse.operators.similar import may_resemble
from sectorpulse.schema import NEWS_COLUMNS, ROW_ID
from sectorpulse.session import cut_lineage

#: Keys of a batch, and titles of it, that are sent to all tasks at most (some 30 and 20 MB).
BROADCAST_KEYS, BATCH_TITLES = 1_000_000, 100_000
KEY_COLUMNS = ("keys", "story_title", "story_link")


def with_keys(df: DataFrame, keep_fragment: bool = False) -> DataFrame:
    """News rows with ``keys`` (16-byte names of link, content and title inside the scope that is compared),
    ``story_title`` (the normalised title) and ``story_link`` (the link whatever its scope, blank if none)."""
    scope = F.concat_ws("\x1f", *news_scope())
    title = text.title_key(F.col("title"))
    found = {**news_keys(keep_fragment), "title": title}
    # Values by name first, so that every text is normalised once.
    named = df.withColumns({"_scope": scope, **{f"_{name}": value for name, value in found.items()}})
    keys = [scoped_key(F.col("_scope"), name, F.col(f"_{name}")) for name in found]
    return named.withColumns({
        "keys": F.array_compact(F.array(*keys)),
        "story_title": F.coalesce("_title", F.lit("")),
        "story_link": F.coalesce("_link", F.lit("")),
    }).drop("_scope", *[f"_{name}" for name in found])


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` (cut from its lineage), marked for broadcast if it is small enough for that."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= most else df


def unseen(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (both ``with_keys``) whose link is blank or not stored; the table is scanned, not shuffled."""
    asked = new.filter("story_link != ''").select("story_link").distinct()
    known = stored.select("story_link").join(_small(asked, BROADCAST_KEYS), "story_link", "left_semi").distinct()
    return new.join(known, "story_link", "left_anti").select(*new.columns)


def _resembling(stored: DataFrame, new: DataFrame) -> DataFrame | None:
    """Ids of stored rows that may resemble a new title; None if the batch has too many titles to be sent around."""
    scope = F.concat_ws("\x1f", *news_scope()).alias("scope")
    titles = new.filter("story_title != ''").select(scope, "story_title").distinct()
    sent = [tuple(row) for row in titles.limit(BATCH_TITLES + 1).collect()]
    if len(sent) > BATCH_TITLES:
        return None
    shared = stored.sparkSession.sparkContext.broadcast(sent)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = may_resemble(shared.value)
        for batch in batches:
            hit = [test(p, t) for p, t in zip(batch["scope"], batch["story_title"])]
            yield batch.loc[hit, [ROW_ID]]

    held = stored.filter("story_title != ''").select(ROW_ID, scope, "story_title")
    return held.mapInPandas(find, f"{ROW_ID} long")


@dataclass(frozen=True)
class Delta:
    """``added``: new rows that are kept. ``removed``: stored rows that fall to them."""

    added: DataFrame
    removed: DataFrame


def merge_delta(stored: DataFrame, new: DataFrame, fuzzy: bool = True, keep_fragment: bool = False) -> Delta:
    """What ``merge`` changes of a settled table. Both frames are ``with_keys``; ids of ``new`` are the later ones."""
    new = cut_lineage(new)
    keys = _small(new.select(F.explode("keys").alias("key")).distinct(), BROADCAST_KEYS)
    met = stored.select(ROW_ID, F.explode("keys").alias("key")).join(keys, "key", "left_semi").select(ROW_ID)
    if fuzzy:
        alike = _resembling(stored, new)
        met = stored.select(ROW_ID) if alike is None else met.unionByName(alike)
    ids = _small(met.distinct(), BROADCAST_KEYS)
    touched = cut_lineage(stored.join(ids, ROW_ID, "left_semi"))
    columns = [ROW_ID, *NEWS_COLUMNS]
    rows = touched.select(*columns).unionByName(new.select(*columns))
    decided = select_news(rows, news_scope(), fuzzy, keep_fragment).decisions
    kept = cut_lineage(decided.filter("is_leader").select(ROW_ID))
    return Delta(new.join(kept, ROW_ID, "left_semi"), touched.join(kept, ROW_ID, "left_anti"))


def settle(df: DataFrame, fuzzy: bool = True, keep_fragment: bool = False) -> DataFrame:
    """Any news rows as a settled table's rows, ``with_keys``."""
    return with_keys(dedupe_news(df, fuzzy, keep_fragment=keep_fragment), keep_fragment)
