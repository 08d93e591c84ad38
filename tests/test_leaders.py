"""Distributed selection against a plain sequential scan, on many small random partitions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sectorpulse.operators import similar
from sectorpulse.operators.leaders import assign_followers, select_leaders
from sectorpulse.operators.similar import SAME_EVENT, SAME_STORY, Similarity

SCHEMA = "row_id long, g string, pos double, link string, content string, title string"


def grams(t):
    return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {t} - {""}


def ratio(kept, new):
    return SequenceMatcher(None, kept, new).ratio()


def scan(rows, keys, similar_to):
    """Oracle: walk in order, keep unless a kept row shares a key or is similar."""
    kept = []
    for row in rows:
        rivals = (
            k for k in kept
            if any(row[i] and row[i] == k[i] for i in keys) or (row[5] and k[5] and similar_to(k[5], row[5]))
        )
        if next(rivals, None) is None:
            kept.append(row)
    return {r[0] for r in kept}


def partitions(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


def random_rows(seed, groups, size, alphabet, lengths):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        seeds = ["".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(3)]
        for _ in range(size):
            title = list(rng.choice(seeds))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(title) + 1)
                title[at : at + rng.choice([0, 1])] = rng.choice(alphabet) * rng.choice([0, 1, 1])
            rows.append((
                len(rows), f"g{g}", float(rng.randrange(6)), rng.choice(["", "", *"abcdefgh"]),
                rng.choice(["", "", "", *"uvwxyz"]), rng.choice(["", "".join(title), "".join(title)]),
            ))
    rng.shuffle(rows)
    return rows


def leaders(df, exact, **options):
    picked = select_leaders(
        df, order_by=[F.col("pos")], partition_by=[F.col("g")], exact={k: F.col(k) for k in exact}, **options
    )
    return picked, {r[0] for r in picked.decisions.filter("is_leader").collect()}


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_exact_keys(spark, hot):
    rows = random_rows(1, 300, 12, "abc", [2, 3])
    df = spark.createDataFrame(rows, SCHEMA)
    _, got = leaders(df, ["link", "content", "title"], hot_key_rows=hot)
    expected = set().union(*(scan(g, (3, 4, 5), lambda a, b: False) for g in partitions(rows).values()))
    assert got == expected


def test_chain_keeps_every_second_row(spark):
    rows = [(i, "g", float(-i), link, "", title) for i, (link, title) in enumerate(
        [("L1", "T1"), ("L1", "T2"), ("L2", "T2"), ("L2", "T3"), ("L3", "T3")])]
    _, got = leaders(spark.createDataFrame(rows, SCHEMA), ["link", "title"])
    assert got == {0, 2, 4}


def test_long_chain_takes_few_rounds(spark):
    """Each link of a chain cost a round, whose jobs are most of the time of small selections."""
    rows = [(i, "g", float(-i), f"L{(i + 1) // 2}", "", f"T{i // 2}") for i in range(41)]
    df = spark.createDataFrame(rows, SCHEMA)
    picked, got = leaders(df, ["link", "title"])
    assert got == set(range(0, 41, 2))
    assert picked.rounds <= 2
    assert leaders(df.limit(9), ["link", "title"], tail_rows=0)[1] == set(range(0, 9, 2))


@pytest.mark.parametrize("tail", [0, 25, 10**6])
def test_tail_decides_as_rounds_do(spark, tail):
    rows = random_rows(5, 40, 14, "abcdefgh", [6, 9, 12, 17, 25])
    df = spark.createDataFrame(rows, SCHEMA)
    _, got = leaders(df, ["link", "content"], title=F.col("title"), similarity=SAME_STORY, tail_rows=tail)
    groups = partitions(rows).values()
    assert got == set().union(*(scan(g, (3, 4, 5), lambda a, b: ratio(a, b) >= 0.88) for g in groups))


@pytest.mark.parametrize("budget,block,hot", [(10**9, 4096, 10**6), (60, 4096, 10**6), (10**9, 3, 2)])
def test_fuzzy_titles(spark, monkeypatch, budget, block, hot):
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    rows = random_rows(2, 60, 14, "abcdefgh", [6, 9, 12, 17, 25]) + [
        (100_000 + i, "long", float(i % 7), "", "", t)
        for i, t in enumerate(_long_titles())
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    picked, got = leaders(
        df, ["link", "content"], title=F.col("title"), similarity=SAME_STORY,
        pair_budget=budget, hot_key_rows=hot,
    )
    groups = partitions(rows)
    expected = set().union(
        *(scan(g, (3, 4, 5), lambda a, b: ratio(a, b) >= 0.88) for g in groups.values())
    )
    assert got == expected
    exact_only = set().union(*(scan(g, (3, 4, 5), lambda a, b: False) for g in groups.values()))
    assert len(expected) < len(exact_only)


def _long_titles():
    """Beyond 200 characters the ratio ignores popular characters; the bounds must still hold."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghijklmnop", k=n)) for n in (190, 230, 400)]
    for text in base:
        for _ in range(6):
            chars = list(text)
            for _ in range(rng.choice([1, 3, 10, 30])):
                chars[rng.randrange(len(chars))] = rng.choice("qrst")
            yield "".join(chars)


def cluster_scan(rows, rule):
    clusters, out = [], {}
    for row in rows:
        home = next((c for c in clusters if row[5] and c[5] and rule(c[5], row[5])), None)
        if home is None:
            clusters.append(row)
        out[row[0]] = (home or row)[0]
    return out


def same_event(a, b):
    x, y = grams(a), grams(b)
    overlap = len(x & y) / len(x | y)
    return overlap >= 0.5 or (overlap >= 0.3 and ratio(a, b) >= 0.88)


@pytest.mark.parametrize("budget", [10**9, 60])
@pytest.mark.parametrize("similarity,rule", [
    (SAME_EVENT, same_event),
    (Similarity(ratio=None, jaccard=0.5), lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5),
])
def test_clusters(spark, budget, similarity, rule):
    rows = random_rows(3, 60, 14, "abcdef", [1, 4, 9, 14, 20])
    df = spark.createDataFrame(rows, SCHEMA)
    picked, _ = leaders(df, [], title=F.col("title"), similarity=similarity, pair_budget=budget)
    placed = assign_followers(picked).collect()
    id_of = {r["rank"]: r["row_id"] for r in placed}
    got = {r["row_id"]: id_of[r["leader_rank"]] for r in placed}
    expected = {}
    for group in partitions(rows).values():
        expected.update(cluster_scan(group, rule))
    assert got == expected
