"""Ranked lists: sections, hot list, alert batch, daily report, digest input.

Only finished lists are cut. Where a list is made of the first of several reports of an event, rows are
compared in windows of their order that grow until the list is full: what comes later cannot change
which earlier rows lead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorpulse.functions import times
from sectorpulse.functions.text import title_key
from sectorpulse.operators.filters import in_last_hours, is_today, last_day, of_today, published, push_worthy
from sectorpulse.operators.increments import append_history, unpushed
from sectorpulse.operators.leaders import Selection, assign_followers, select_leaders
from sectorpulse.operators.score import ANALYSIS, hot_score, target_sectors
from sectorpulse.operators.similar import SAME_EVENT, SAME_STORY, Similarity
from sectorpulse.schema import ROW_ID, is_event
from sectorpulse.session import cut_lineage

# List sizes.
HOT_ITEMS, HOT_LEAST_TODAY = 5, 3
ALERT_ITEMS = 8
REPORT_ITEMS = 12
DIGEST_ITEMS, DIGEST_SECTORS, DIGEST_CHARS = 15, 5, 120
SECTION_ITEMS = 30
RELATED_SHOWN = 8
# Rows of the first window, and its growth; a schedule only, results do not depend on it.
FIRST_WINDOW, WINDOW_GROWTH, LARGEST_WINDOW = 64, 16, 1 << 16


def by_importance() -> list[Column]:
    return [F.col(ANALYSIS)["importance"].desc(), published().desc_nulls_last(), F.col(ROW_ID).asc()]


def by_time() -> list[Column]:
    return [published().desc_nulls_last(), F.col("publish_time").desc(), F.col(ROW_ID).asc()]


def sort_by_importance(df: DataFrame) -> DataFrame:
    return df.orderBy(*by_importance())


def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy(*by_time())


def top_per(df: DataFrame, groups: list[Column], n: int, name: str = "place") -> DataFrame:
    """The ``n`` most important rows of each group with their place."""
    order = Window.partitionBy(*groups).orderBy(*by_importance())
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def clusters(
    df: DataFrame, partition_by: list[Column], similarity: Similarity = SAME_EVENT, **options
) -> Selection:
    """Reports of the same event under their most important one (its leader)."""
    return select_leaders(
        df,
        order_by=[F.col(ANALYSIS)["importance"], published()],
        partition_by=list(partition_by),
        exact={},
        title=title_key(F.col("title")),
        similarity=similarity,
        **options,
    )


def cluster_table(df: DataFrame, selection: Selection) -> DataFrame:
    """``df`` with rank, is_leader and the row id of its leader."""
    placed = assign_followers(selection)
    ids = placed.filter("is_leader").select(
        F.col("rank").alias("leader_rank"), F.col(ROW_ID).alias("leader_id")
    )
    return df.join(placed.join(ids, "leader_rank"), ROW_ID)


def related_reports(clustered: DataFrame) -> DataFrame:
    """Per leader: how many other reports there are, and the first few of them in order."""
    followers = clustered.filter(~F.col("is_leader"))
    counts = followers.groupBy("leader_id").agg(F.count(F.lit(1)).alias("related_count"))
    order = Window.partitionBy("leader_id").orderBy("rank")
    shown = followers.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= RELATED_SHOWN
    )
    item = F.struct("_n", "title", "source", "publish_time", "link")
    lists = shown.groupBy("leader_id").agg(F.sort_array(F.collect_list(item)).alias("related"))
    leaders = clustered.filter("is_leader").drop("leader_id")
    return (
        leaders.join(counts, leaders[ROW_ID] == counts["leader_id"], "left")
        .drop("leader_id")
        .join(lists, leaders[ROW_ID] == lists["leader_id"], "left")
        .drop("leader_id")
        .withColumn("related_count", F.coalesce("related_count", F.lit(0)))
    )


def section_scope() -> list[Column]:
    """Lists shown: one per sector, one for all event news."""
    return [is_event(), F.when(is_event(), "").otherwise(F.col("sector"))]


def sections(df: DataFrame, max_items: int = SECTION_ITEMS) -> DataFrame:
    """Per section its first ``max_items`` event clusters, with all their reports."""
    clustered = cluster_table(df, clusters(df, section_scope()))
    listed = related_reports(clustered)
    order = Window.partitionBy(*section_scope()).orderBy("rank")
    return listed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_items)


def hot_candidates(df: DataFrame, selected: list[str], as_of) -> DataFrame:
    """Rows of today or the last day with their hot score, events only when related."""
    chosen = [s.strip() for s in selected if s.strip()]
    related = F.lit(False)
    if chosen:
        related = F.arrays_overlap(target_sectors(), F.array(*[F.lit(s) for s in chosen]))
    scored = last_day(df, as_of).withColumns(
        {
            "_related": related,
            "is_today": is_today(as_of),
            "hot_score": hot_score(published(), times.as_of_ts(as_of), related),
        }
    )
    if chosen:
        scored = scored.filter(~is_event() | F.col("_related"))
    return scored.filter(F.col("is_today") | in_last_hours(as_of)).drop("_related")


def first_leaders(
    held: DataFrame, order: list[Column], n: int, select: Callable[[DataFrame], Selection]
) -> DataFrame:
    """The first ``n`` rows of ``held`` in ``order`` that lead, under ``select`` in that order.

    ``held`` is read several times: cut it from its lineage.
    """
    window = max(FIRST_WINDOW, 4 * n)
    total = held.count()
    while True:
        best = held.orderBy(*order).limit(window) if window < total else held
        leaders = select(best).decisions.filter("is_leader").select(ROW_ID)
        found = best.join(leaders, ROW_ID, "left_semi").orderBy(*order).limit(n)
        if window >= total or found.count() >= n:
            return found
        window = window * WINDOW_GROWTH if window < LARGEST_WINDOW else total


def hot_list(
    df: DataFrame, selected: list[str], as_of, limit: int = HOT_ITEMS
) -> tuple[DataFrame, bool]:
    """Best rows of today, topped up from the last 24 hours when today has too few."""
    candidates = cut_lineage(hot_candidates(df, selected, as_of))
    today = candidates.filter("is_today")
    fallback = False
    if today.limit(HOT_LEAST_TODAY).count() < HOT_LEAST_TODAY:
        fallback = not candidates.filter(~F.col("is_today")).isEmpty()
    pool = candidates if fallback else today
    order = [F.col("hot_score").desc(), F.col("is_today").desc(), F.col(ROW_ID).asc()]

    def select(rows: DataFrame) -> Selection:
        return select_leaders(
            rows,
            order_by=[F.col("hot_score"), F.col("is_today")],
            exact={},
            title=title_key(F.col("title")),
            similarity=SAME_STORY,
        )

    return first_leaders(pool, order, limit, select), fallback


def alert_batch(df: DataFrame, history: DataFrame, as_of) -> DataFrame:
    """Important recent rows that were not pushed yet, best first."""
    fresh = unpushed(push_worthy(df, as_of), history)
    return fresh.orderBy(*by_importance()).limit(ALERT_ITEMS)


def daily_report(df: DataFrame, as_of) -> DataFrame:
    """Leaders of the most important events of the last 24 hours."""
    recent = cut_lineage(last_day(df, as_of).filter(in_last_hours(as_of)))
    return first_leaders(recent, by_importance(), REPORT_ITEMS, lambda rows: clusters(rows, []))


def report_and_history(df: DataFrame, history: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """The daily report, and the history once it is delivered: a reported story is no alert any more."""
    report = cut_lineage(daily_report(df, as_of))
    placed = report.orderBy(*by_importance()).withColumn("seq", F.monotonically_increasing_id())
    return report, append_history(history, placed, limit=None)


def digest_input(df: DataFrame, selected: list[str], as_of) -> DataFrame:
    """Per selected sector today's most important rows, as one JSON list."""
    chosen = list(selected)[:DIGEST_SECTORS]
    today = of_today(df, as_of).filter(F.col("sector").isin(chosen))
    top = top_per(today, [F.col("sector")], DIGEST_ITEMS)
    item = F.struct(
        "place",
        F.struct(
            "title",
            F.col("publish_time").alias("time"),
            "source",
            F.substring("content", 1, DIGEST_CHARS).alias("summary"),
        ).alias("news"),
    )
    lists = top.groupBy("sector").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return lists.select(
        "sector",
        F.size("items").alias("count"),
        F.to_json(F.transform("items", lambda i: i["news"])).alias("news"),
    )
