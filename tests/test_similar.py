"""Bounds on pairs of titles against the plain ratio, and how many edges leave a block."""

import random
from difflib import SequenceMatcher

import pandas as pd

from sectorpulse.operators import similar
from sectorpulse.operators.similar import SAME_EVENT, SAME_STORY, Comparison


def _titles(rng, n, alphabet):
    titles = []
    for _ in range(n):
        text = "".join(rng.choices(alphabet, k=rng.choice([1, 2, 9, 60, 190, 230, 400])))
        for _ in range(3):
            chars = list(text)
            for _ in range(rng.choice([0, 1, len(text) // 12, len(text) // 7])):
                chars[rng.randrange(len(chars))] = rng.choice(alphabet)
            titles.append("".join(chars))
    return titles


def test_comparison_is_the_plain_ratio():
    rng = random.Random(3)
    titles = _titles(rng, 12, "thenaringed" + "xyz") + _titles(rng, 6, "ab")
    test, hits = Comparison(SAME_STORY), 0
    for a in titles:
        for b in titles:
            expected = SequenceMatcher(None, a, b).ratio() >= SAME_STORY.ratio
            assert test(a, b) == expected
            hits += expected
    assert hits > len(titles)


def test_folded_columns_lose_no_pair(monkeypatch):
    rng = random.Random(4)
    titles = sorted(set(_titles(rng, 10, "abcdefghijklmnop")))
    rows = pd.DataFrame({
        "side": 0, "tk": [t.encode() for t in titles], "title": titles, "rank": 0, "first_rank": 0, "last_rank": 1,
    })
    for own, folded in ((4096, 1024), (5, 3)):
        monkeypatch.setattr(similar, "OWN_COLUMNS", own)
        monkeypatch.setattr(similar, "SHARED_COLUMNS", folded)
        for similarity in (SAME_STORY, SAME_EVENT):
            test = Comparison(similarity)
            expected = {(a.encode(), b.encode()) for a in titles for b in titles if a != b and test(a, b)}
            found = similar._block_edges(similarity, True)(rows)
            assert set(zip(found["src"], found["dst"])) == expected and expected


def test_later_titles_get_one_edge_a_block():
    """A burst of near copies does not make an edge for each pair of a kept and a later title."""
    base = "a story that many wires report again and again"
    kept = pd.DataFrame({"side": 0, "title": [f"{base}{i:02d}" for i in range(40)], "rank": range(40, 0, -1)})
    later = pd.DataFrame({"side": 1, "title": [f"{base}{i:02d}" for i in range(40, 90)], "rank": 99})
    rows = pd.concat([kept, later]).assign(first_rank=0, last_rank=100)
    rows["tk"] = rows["title"].str.encode("utf-8")
    found = similar._block_edges(SAME_STORY, False)(rows)
    assert len(found) == len(later) and set(found["src"]) == {f"{base}39".encode()}


def test_tiles_and_sides_lose_no_pair(monkeypatch):
    """Blocks of several tiles, and two blocks of different size, against all pairs."""
    rng = random.Random(6)
    titles = sorted(set(_titles(rng, 14, "abcdefghijklmnop")) | set(_titles(rng, 4, "abc")))
    rows = pd.DataFrame({
        "side": [int(rng.random() < 0.3) for _ in titles], "tk": [t.encode() for t in titles], "title": titles,
        "rank": rng.sample(range(len(titles)), len(titles)), "first_rank": 0, "last_rank": 1,
    })
    side = dict(zip(rows["tk"], rows["side"]))
    rank = dict(zip(rows["tk"], rows["rank"]))
    for tile, columns in ((1024, 4096), (32, 64)):
        monkeypatch.setattr(similar, "TILE_ROWS", tile)
        monkeypatch.setattr(similar, "MOST_COLUMNS", columns)
        for similarity in (SAME_STORY, SAME_EVENT):
            test = Comparison(similarity)
            takes = {(a.encode(), b.encode()) for a in titles for b in titles if a != b and test(a, b)}
            both = {(a, b) for a, b in takes if side[a] != side[b]}
            found = similar._block_edges(similarity, True)(rows)
            assert set(zip(found["src"], found["dst"])) == both and both
            onward = {}
            for a, b in both:
                if side[a] == 0 and rank[a] < rank[onward.get(b, a)] or b not in onward and side[a] == 0:
                    onward[b] = a
            found = similar._block_edges(similarity, False)(rows)
            assert dict(zip(found["dst"], found["src"])) == onward and len(found) == len(onward)


def test_pairs_of_long_titles_are_not_compared_one_by_one(monkeypatch):
    """Unlike titles of few letters share nearly all pieces of two characters, and each pair was compared by itself."""
    rng = random.Random(8)
    words = ["".join(rng.choices(["th", "er", "on", "an", "in", "ti", "es", "re"], k=rng.choice([1, 2, 3]))) for _ in range(300)]
    for words_each in (22, 60):
        titles = ["".join(rng.choices(words, k=words_each)) for _ in range(200)]
        rows = pd.DataFrame({
            "side": 0, "tk": [t.encode() for t in titles], "title": titles, "rank": 0, "first_rank": 0, "last_rank": 1,
        })
        tested = []
        monkeypatch.setattr(Comparison, "__call__", lambda self, a, b: tested.append((a, b)) or False)
        similar._block_edges(SAME_STORY, True)(rows)
        assert len(tested) < 200 * 199 / 50
