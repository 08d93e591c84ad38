"""Operator 6 against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sectorpulse.llm import near_join
from sectorpulse.llm.common import written
from sectorpulse.llm.components import _stars, components


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted((doc, len(sets[k]), least[root(k)]) for k, (doc, _) in enumerate(rows))


def near_copies(seed):
    r, rows = random.Random(seed), []
    for length in (1, 2, 4, 5, 6, 7, 9, 12, 20, 30, 60, 150):
        for _ in range(3):
            base = [str(r.randint(0, 200)) for _ in range(length)]
            for _ in range(7):
                words = list(base)
                for _ in range(r.choice([0, 1, 1, 2, 3, max(1, length // 30)])):
                    words[r.randrange(length)] = str(r.randint(0, 200))
                rows.append((len(rows), " ".join(words[: r.randint(max(1, length - 2), length)])))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A B c D e"), (1004, "a b C d\te")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, percent", [(4, 85), (1, 50)])
def test_components_are_those_of_all_pairs(frame, size, percent):
    rows = near_copies(size)
    found = near_join.join(frame(rows), size, percent).collect()
    assert sorted(map(tuple, found)) == brute(rows, size, percent)


def burst(seed, words=110, copies=90, others=120):
    """One group of copies around the threshold that holds a third of all rows and more, outliers, and plain rows."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    rows = []
    for k in range(copies):
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8, 15])):
            text[r.randrange(words)] = f"x{r.randint(0, 5000)}"
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, " ".join(base[: words // 2] + [f"y{r.randint(0, 5000)}" for _ in range(words // 2)])) for k in range(20)]
    rows += [(2000 + k, " ".join(f"z{r.randint(0, 5000)}" for _ in range(words))) for k in range(others)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_a_group_of_a_third_of_all_rows_with_outliers(frame, percent):
    rows = burst(percent)
    found = sorted(map(tuple, near_join.join(frame(rows), 4, percent).collect()))
    assert found == brute(rows, 4, percent)


def test_a_pair_of_many_buckets_is_named_by_few(frame, monkeypatch):
    kept = {}

    def noted(df, name, **options):
        kept.setdefault(name, []).append(written(df, name, **options))
        return kept[name][-1]

    monkeypatch.setattr(near_join, "written", noted)
    near_join.join(frame(burst(3, words=240)), 4, 85).collect()
    mixed = kept["near-mixed"][-1]
    met = mixed.alias("x").join(mixed.alias("y"), "sig").where("x.class < y.class AND x.label != y.label")
    once = met.where("NOT arrays_overlap(x.before, y.before)").select("x.class", "y.class")
    pairs = met.select("x.class", "y.class").distinct().count()
    # No pair is lost, and most meetings after the first are passed over.
    assert 0 < pairs == once.distinct().count() <= once.count() < met.count() / 3


def test_signatures_are_subsets_of_two_parts_of_three():
    levels, hashes = near_join.Levels(85), np.sort(near_join._mixed(np.arange(1, 401).astype(np.uint64)))
    band = levels.band(400)
    most = sum(near_join.PARTS * ((levels.differences(x) + 1) // 2 + 2) for x in (band, band + 1))
    found = levels.signatures(hashes)
    assert most - 3 <= len(found) <= most and len(np.unique(found)) == len(found)
    # One shingle more or less touches one part of one group a level: two of its three subsets.
    assert len(np.setdiff1d(found, levels.signatures(hashes[1:]))) <= 4


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(1)
    for percent in (50, 80, 85, 100):
        levels = near_join.Levels(percent)
        for n in (1, 2, 5, 6, 7, 8, 13, 40, 200, 1500):
            for _ in range(40):
                one = r.integers(0, 2**63, n).astype(np.uint64)
                gone = r.integers(0, n * (100 - percent) // 100 + 1)
                other = one[gone:]
                most = (100 * len(other) - percent * n) // percent if percent < 100 else 0
                other = np.concatenate([other, r.integers(0, 2**63, r.integers(0, max(0, most) + 1)).astype(np.uint64)])
                one, other = np.unique(one), np.unique(other)
                both = len(np.intersect1d(one, other))
                if 100 * both >= percent * (len(one) + len(other) - both):
                    assert len(np.intersect1d(levels.signatures(one), levels.signatures(other)))


def test_missing_and_repeated_ids(frame):
    base = " ".join(map(str, range(60)))
    rows = [(1, base), (1, base + " z"), (1, "q " * 9), (None, base + " y"), (None, "u v w x y z"), (5, "u v w x y z")]
    rows += [(None, None), (7, base.upper() + " Z")]
    found = sorted(map(str, near_join.join(frame(rows), 4, 85).select("id", "n_shingles", "component_id").collect()))
    assert [x for x in found if "id=5" in x or "n_shingles=3," in x] == sorted(
        ["Row(id=5, n_shingles=3, component_id=5)", "Row(id=None, n_shingles=3, component_id=5)"]
    )
    assert "Row(id=7, n_shingles=58, component_id=1)" in found
    kept = near_join.keep_one(frame(rows), 4, 85)
    assert 7 not in {r.doc_id for r in kept.collect()} and kept.columns == frame(rows).columns


def test_empty_table(frame):
    assert near_join.join(frame([])).collect() == [] == near_join.keep_one(frame([])).collect()


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 300), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}


def test_dense_edges_come_out_as_stars(monkeypatch):
    edges = [(a, b) for b in range(60) for a in range(b)] + [(100, 101), (5, 5)]
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in edges[k : k + 100]]) for k in range(0, len(edges), 100)]
    found = sorted((r["a"], r["b"]) for x in _stars(batches) for r in x.to_pylist())
    assert found == [(0, k) for k in range(1, 60)] + [(100, 101)]
    monkeypatch.setattr("sectorpulse.llm.components.JOINED_NODES", 10)
    several = {(r["a"], r["b"]) for x in _stars(batches) for r in x.to_pylist()}
    assert {b for _, b in several} == {*range(1, 60), 101} and several <= {(min(e), max(e)) for e in edges}


@pytest.mark.parametrize("size, percent", [(4, 85), (1, 50), (5, 80), (1, 3), (2, 100)])
def test_similar_sets_have_first_hashes_in_common(size, percent):
    sets = [near_join.shingles(text or "", size) for _, text in near_copies(7)]
    first = [set(near_join.first_hashes(x, percent).tolist()) for x in sets]
    linked = 0
    for a, one in enumerate(sets):
        for b, other in enumerate(sets):
            both = len(np.intersect1d(one, other))
            if a != b and both and 100 * both >= percent * (len(one) + len(other) - both):
                linked += 1
                assert len(first[a] & first[b]) >= near_join.asked(len(one), percent)
    assert linked > 50


def test_only_classes_that_may_have_a_partner_are_signed(frame):
    """All texts were signed, some 200 rows each, though few have a partner (pipeline: disk)."""
    r = random.Random(11)
    line = " ".join(str(r.random()) for _ in range(12))
    texts = [[str(r.random()) for _ in range(300)] for _ in range(40)]
    rows = [(k, " ".join([*words, line])) for k, words in enumerate(texts)]
    rows += [(100 + k, " ".join(["other", *texts[k]])) for k in range(3)]
    docs = frame(rows).selectExpr("doc_id id", "text")
    classes = docs.mapInArrow(near_join._described(5), near_join.CLASSES)
    found = {r["id"] for r in near_join.partners(docs, classes, 5, 80).collect()}
    assert found == {0, 1, 2, 100, 101, 102}
    got = {r["id"]: r["component_id"] for r in near_join.join(frame(rows)).collect()}
    assert got == {k: k % 100 for k, _ in rows}
