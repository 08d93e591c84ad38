"""Operator 9 against every window at every place."""

import hashlib
import random
import re

import pytest

from sectorpulse.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    found = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in range(1, window + 1):
            for k in range(len(w) - n + 1):
                if (here := tuple(w[k : k + n])) in windows:
                    names |= windows[here]
                    hit |= set(range(k, k + n))
        listed = sorted(str(x) for x in names if x is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        found.append((doc, len(w), len(hit), len(listed), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(found, key=str)


def marked(spark, docs, items, window, **options):
    rows = decontaminate.mark(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        window,
        **options,
    )
    columns = ("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted(map(tuple, rows.select(*columns).collect()), key=str)


R = random.Random(5)
LETTERS = "a b C d é Ñ 1".split()
DOCS = [(k, " ".join(R.choice(LETTERS) + R.choice(["", ".", ", ", "\n"]) for _ in range(R.randint(0, 60)))) for k in range(80)]
DOCS += [(300, None), (300, "a b c"), (None, "a b a b")]
ITEMS = [(k, " ".join(R.choice(LETTERS) for _ in range(R.randint(0, 7)))) for k in range(30)]
ITEMS += [(77, None), (None, "d d d"), (5, "c c a"), (6, "a"), (500, "é é é é é é")]


@pytest.mark.parametrize("options", [{}, {"segment_words": 50, "block_chars": 60}])
def test_hits_are_those_of_every_window(spark, options):
    assert marked(spark, DOCS, ITEMS, 3, **options) == brute(DOCS, ITEMS, 3)


def test_empty_sides(spark):
    assert marked(spark, DOCS[:5], [], 3) == brute(DOCS[:5], [], 3)
    assert marked(spark, [], ITEMS, 3) == []


def test_keep_clean(spark, frame):
    rows = frame([(1, "x " * 200 + "a b c"), (2, "a b c"), (None, "a b c d"), (3, None), (2, "fine")])
    items = spark.createDataFrame([(1, "A, b c")], "item_id long, text string")
    kept = decontaminate.keep_clean(rows, items)
    assert sorted((str(r.doc_id), r.text and r.text[:4]) for r in kept.collect()) == [("1", "x x "), ("2", "fine"), ("3", None)]
    assert kept.columns == rows.columns


def test_proximity(spark):
    docs = [(1, "a x x b x c"), (2, "c a b"), (3, "a b x x x x x c"), (4, "a"), (5, "b c"), (6, "a b")]
    index = decontaminate.build(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {(r.place, r.first) for r in decontaminate.proximity(index, "a b c", 6).collect()}
    place = {(row.segment, k): i for row in index.collect() for k, i in enumerate(row.doc_ids)}
    near = {place[r.segment, r.place] for r in decontaminate.proximity(index, "a b c", 6).collect()}
    assert near == {1, 2} and found
    assert {place[r.segment, r.place] for r in decontaminate.proximity(index, "c b a", 3).collect()} == {2}
    assert decontaminate.proximity(index, "", 3).collect() == []


def test_varints():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**34], np.int64)
    assert (decontaminate._from_varints(decontaminate._varints(values)) == values).all()
    assert len(decontaminate._from_varints(b"")) == 0
