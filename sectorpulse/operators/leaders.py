"""Greedy keep-first selection as a distributed fix-point.

Scanning in rank order, a row is kept unless it shares a key with, or is similar to, an earlier
*kept* row. A dropped row shields nobody, so neither one row per key nor connected components give
this result. Each round decides at once every row all of whose earlier rivals are decided:

* kept: first undecided row under every one of its keys, and no similar title has an earlier
  undecided row;
* dropped: an earlier kept row shares a key or is similar.

Per round a few shuffles over the rows still undecided, which shrink quickly; aggregates run
before each shuffle, and state is checkpointed so that a lost executor costs one round. Once no more
than ``TAIL_ROWS`` rows with ``TAIL_EDGES`` edges between them are undecided, the scan itself decides
them in a task of that bounded size, so long chains of a few rows cost no round for each link.

Similar pairs are only looked up inside a rank window. The first one's pair load stays within a budget;
how much the next ones hold follows from what the last one kept, and from how many of its pairs were similar.
The rows a window keeps then remove their followers from all later rows, so beyond a window a burst of
near-identical titles costs one comparison each instead of all pairs. Windows change the schedule,
never the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.operators.similar import Similarity, features, pair_load, similar_edges
from sectorpulse.schema import ROW_ID
from sectorpulse.session import cut_lineage

#: Pairs of titles of one scope that the first window compares at most.
PAIR_BUDGET = 50_000_000
#: Similar pairs that a later window may be expected to hold.
EDGE_BUDGET = 20_000_000
HOT_KEY_ROWS = 1_000_000
WINDOW_STEPS = 12
#: Undecided rows, and edges between them, that one task scans at most (some 100 MB).
TAIL_ROWS, TAIL_EDGES = 20_000, 500_000


@dataclass(frozen=True)
class Selection:
    """``decisions``: row_id, rank, tk, is_leader. ``edges``: similar titles used to decide."""

    decisions: DataFrame
    edges: DataFrame | None
    rounds: int


def scoped_key(scope: Column, kind: str, value: Column) -> Column:
    """16-byte identity of a key inside its partition; NULL for a blank value."""
    digest = F.unhex(F.md5(F.concat_ws("\x1f", scope, F.lit(kind), value)))
    return F.when(F.coalesce(value, F.lit("")) != "", digest)


def ranked_rows(
    df: DataFrame,
    order_by: list[Column],
    partition_by: list[Column],
    exact: dict[str, Column],
    title: Column | None,
) -> DataFrame:
    """row_id, rank, keys, and for similarity tk, p, title. Ranks follow ``order_by`` globally.

    A range-partitioned sort spreads any hot partition over many tasks; the increasing id over
    its output is a total order that needs no per-partition counting.
    """
    scope = F.concat_ws("\x1f", *partition_by) if partition_by else F.lit("")
    title_text = F.lit(None).cast("string") if title is None else title
    # Values by name first: a key names its value twice, and texts would be normalised for each.
    values = {f"v_{name}": value for name, value in exact.items() if value is not title}
    named = {name: F.col("v_title_text" if value is title else f"v_{name}") for name, value in exact.items()}
    keys = {f"k_{name}": scoped_key(F.col("p"), name, value) for name, value in named.items()}
    # Kept before the sort: a range sort reads its input twice, and texts are costly to normalise.
    prepared = cut_lineage(df.select(
        ROW_ID,
        scope.alias("p"),
        *[c.alias(f"o_{i}") for i, c in enumerate(order_by)],
        *[c.alias(n) for n, c in values.items()],
        title_text.alias("v_title_text"),
    ).select(
        ROW_ID,
        "p",
        *[f"o_{i}" for i in range(len(order_by))],
        *[c.alias(n) for n, c in keys.items()],
        F.nullif(F.col("v_title_text"), F.lit("")).alias("title"),
    ))
    descending = [F.col(f"o_{i}").desc_nulls_last() for i in range(len(order_by))]
    ordered = prepared.orderBy(*descending, ROW_ID)
    return cut_lineage(
        ordered.select(
            ROW_ID,
            F.monotonically_increasing_id().alias("rank"),
            F.array_compact(F.array(*keys)).alias("keys"),
            scoped_key(F.col("p"), "similar", F.col("title")).alias("tk"),
            "p",
            "title",
        )
    )


def _first_per_key(rows: DataFrame) -> DataFrame:
    members = rows.select("rank", F.explode("keys").alias("k"))
    return members.groupBy("k").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("members")
    )


def _newly_kept(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    firsts = _first_per_key(rows)
    leads = firsts.groupBy(F.col("first").alias("rank")).agg(F.count(F.lit(1)).alias("leads"))
    kept = rows.join(leads, "rank").filter(F.col("leads") == F.size("keys"))
    if edges is not None:
        earliest = edges.join(firsts, F.col("src") == F.col("k")).groupBy("dst")
        blocked = earliest.agg(F.min("first").alias("rival"))
        kept = kept.join(blocked, F.col("tk") == F.col("dst"), "left").filter(
            F.col("rival").isNull() | (F.col("rival") > F.col("rank"))
        )
    return cut_lineage(kept.select("rank", "keys", "tk"))


def _without(rows: DataFrame, taken: DataFrame, hot_rows: int) -> DataFrame:
    """Rows that no (k, kept_rank) of ``taken`` claims.

    Keys with more than ``hot_rows`` members are few by arithmetic (members / hot_rows), so they
    are matched by broadcast and their members never meet in one task.
    """
    members = rows.select("rank", F.explode("keys").alias("k"))
    hot = _first_per_key(rows).filter(F.col("members") > hot_rows).select("k")
    cold_hits = members.join(F.broadcast(hot), "k", "left_anti").join(taken, "k")
    hot_hits = members.join(F.broadcast(taken.join(hot, "k", "left_semi")), "k")
    claimed = cold_hits.unionByName(hot_hits).filter(F.col("rank") >= F.col("kept_rank"))
    return cut_lineage(rows.join(claimed.select("rank").distinct(), "rank", "left_anti"))


def _claims(kept: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(k, kept_rank): keys whose later rows are taken by a kept row."""
    claims = kept.select(F.explode("keys").alias("k"), F.col("rank").alias("kept_rank"))
    if edges is not None:
        similar = edges.join(kept, F.col("src") == F.col("tk"))
        claims = claims.unionByName(
            similar.select(F.col("dst").alias("k"), F.col("rank").alias("kept_rank"))
        )
    return claims.groupBy("k").agg(F.min("kept_rank").alias("kept_rank"))


def _scanned(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The kept ones of a few undecided rows, in the order of their ranks."""
    takes = edges.groupby("src")["dst"].agg(list).to_dict()
    taken: set[bytes] = set()
    kept = []
    for rank, keys, tk in rows.sort_values("rank")[["rank", "keys", "tk"]].itertuples(index=False):
        if taken.isdisjoint(keys):
            kept.append(rank)
            taken.update(keys)
            taken.update(takes.get(tk, ()))
    return pd.DataFrame({"rank": pd.Series(kept, dtype="int64")})


def _tail(undecided: DataFrame, edges: DataFrame | None, rows: int) -> DataFrame | None:
    """The kept rows of ``undecided`` if these are few enough for one task, None otherwise."""
    if undecided.limit(rows + 1).count() > rows:
        return None
    if edges is None:
        between = undecided.limit(0).select(F.col("tk").alias("src"), F.col("tk").alias("dst"))
    else:
        left = F.broadcast(undecided.select("tk").distinct())
        between = edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi")
        between = cut_lineage(between.select("src", "dst").limit(TAIL_EDGES + 1))
        if between.count() > TAIL_EDGES:
            return None
    at = F.lit(0).alias("at")
    held = undecided.select("rank", "keys", "tk").groupBy(at)
    kept = held.cogroup(between.groupBy(at)).applyInPandas(_scanned, "rank long")
    return cut_lineage(undecided.join(F.broadcast(kept), "rank").select("rank", "keys", "tk"))


def _settle(
    rows: DataFrame, edges: DataFrame | None, hot_rows: int, tail_rows: int
) -> tuple[DataFrame, int]:
    """Fix-point over one set of rows: the kept ones and the number of rounds."""
    kept_parts, undecided = [], rows
    while True:
        kept = _newly_kept(undecided, edges)
        kept_parts.append(kept)
        undecided = _without(undecided, _claims(kept, edges), hot_rows)
        if not undecided.isEmpty():
            rest = _tail(undecided, edges, tail_rows)
            if rest is None:
                continue
            kept_parts.append(rest)
        return reduce(DataFrame.unionByName, kept_parts), len(kept_parts)


def _window_limit(pending: DataFrame, titles: DataFrame, budget: int, share: float, most: float) -> tuple[int | None, int]:
    """Rank up to which a window goes (None when everything fits) and its pair load.

    Kept titles are compared with all later ones anyway, so a window may hold the ``share`` of the titles that the last
    one kept without adding much work, as far as these are ``most`` pairs; and it may always hold ``budget`` pairs.
    """
    left = titles.join(pending.select("tk").distinct(), "tk", "left_semi")
    load = pair_load(left)[0]
    allowed = max(budget, min(load if share >= 0.5 else share * share * load, most))
    if load <= allowed:
        return None, load
    shares = [2.0**-i for i in range(1, WINDOW_STEPS + 1)]
    limits = [int(x) for x in pending.approxQuantile("rank", shares, 1e-4)]
    loads = list(zip(pair_load(left, limits), limits))
    held, limit = max([found for found in loads if found[0] <= allowed], default=min(loads))
    return limit, held


def select_leaders(
    df: DataFrame,
    *,
    order_by: list[Column],
    partition_by: list[Column] = (),
    exact: dict[str, Column],
    title: Column | None = None,
    similarity: Similarity | None = None,
    pair_budget: int = PAIR_BUDGET,
    hot_key_rows: int = HOT_KEY_ROWS,
    tail_rows: int = TAIL_ROWS,
) -> Selection:
    """Keep-first selection over ``df`` (needs a unique ``row_id``).

    ``order_by``: columns, all descending with NULLS LAST; ``row_id`` breaks ties upwards.
    ``exact``: named key columns, blank never matches. ``title``: text compared by ``similarity``.
    """
    if similarity is not None:
        exact = {**exact, "similar": title}
    rows = ranked_rows(df, order_by, list(partition_by), exact, title)
    loners = rows.filter(F.size("keys") == 0).select("rank")
    pending = rows.filter(F.size("keys") > 0)
    edge_parts: list[DataFrame] = []
    kept_parts: list[DataFrame] = []
    rounds = 0
    if pending.isEmpty():
        pass
    elif similarity is None:
        kept, rounds = _settle(pending, None, hot_key_rows, tail_rows)
        kept_parts.append(kept)
    else:
        named = pending.filter(F.col("tk").isNotNull())
        titles = features(
            named.groupBy("tk").agg(
                F.first("p").alias("p"),
                F.first("title").alias("title"),
                F.min("rank").alias("first_rank"),
                F.max("rank").alias("last_rank"),
            )
        )
        share, most = 0.0, 0.0
        while True:
            limit, load = _window_limit(pending, titles, pair_budget, share, most)
            window = pending if limit is None else pending.filter(F.col("rank") <= limit)
            inside = titles
            if edge_parts or limit is not None:
                inside = titles.join(window.select("tk").distinct(), "tk", "left_semi")
            edges = similar_edges(inside, similarity)
            kept, used = _settle(window, edges, hot_key_rows, tail_rows)
            rounds += used
            kept_parts.append(kept)
            edge_parts.append(edges)
            if limit is None:
                break
            later = pending.filter(F.col("rank") > limit)
            kept_titles = kept.filter(F.col("tk").isNotNull()).select("tk", "rank")
            share = kept_titles.count() / max(1, inside.count())
            most = EDGE_BUDGET * load / max(1, edges.count())
            across = similar_edges(
                titles,
                similarity,
                leaders=kept_titles,
                others=later.select("tk").distinct(),
            )
            edge_parts.append(across)
            pending = _without(later, _claims(kept, across), hot_key_rows)
            if pending.isEmpty():
                break
    leaders = reduce(
        DataFrame.unionByName, [part.select("rank") for part in kept_parts], loners
    ).withColumn("is_leader", F.lit(True))
    decisions = rows.select(ROW_ID, "rank", "tk").join(leaders, "rank", "left")
    is_leader = F.coalesce("is_leader", F.lit(False)).alias("is_leader")
    decisions = decisions.select(ROW_ID, "rank", "tk", is_leader)
    edges = reduce(DataFrame.unionByName, edge_parts) if edge_parts else None
    return Selection(decisions, edges, rounds)


def assign_followers(selection: Selection) -> DataFrame:
    """row_id, rank, is_leader, leader_rank: each row under its first-created similar leader."""
    decided = selection.decisions
    leaders = decided.filter("is_leader").select("tk", F.col("rank").alias("leader_rank"))
    named = leaders.filter(F.col("tk").isNotNull())
    claims = named.select("tk", "leader_rank")
    if selection.edges is not None:
        similar = selection.edges.join(named, F.col("src") == F.col("tk"))
        claims = claims.unionByName(similar.select(F.col("dst").alias("tk"), "leader_rank"))
    first = claims.groupBy("tk").agg(F.min("leader_rank").alias("leader_rank"))
    joined = decided.join(first, "tk", "left")
    own = F.when(F.col("is_leader"), F.col("rank")).otherwise(F.col("leader_rank"))
    return joined.select(ROW_ID, "rank", "is_leader", own.alias("leader_rank"))
