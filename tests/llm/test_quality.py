"""Operator 3: counts and ratios by dictionaries, held-out accuracy, exact top-k."""

import math
import random
from collections import Counter

import numpy as np

from sectorpulse.llm import quality

R = random.Random(3)
COMMON = [f"w{k}" for k in range(400)]
NO_LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    rows, labels = [], []
    for doc in range(n):
        words = [R.choice(COMMON) for _ in range(R.randint(30, 200))]
        kind = R.choice(["clean"] * 7 + ["toxic", "junk"])
        if kind == "toxic":
            words.insert(R.randrange(len(words)), R.choice(["scum", "idiot"]) + R.choice(["", "s", "ic"]))
        if kind == "junk":
            words = [w + "%%" for w in words]
        rows.append((doc, " ".join(words)))
        labels.append((doc, int(kind != "junk"), int(kind == "toxic"), kind))
    return rows, labels


def test_ratios_are_those_of_dictionaries(spark):
    rows, labels = corpus(40)
    clean = {doc for doc, _, _, kind in labels if kind == "clean" and doc % 2}
    given = spark.createDataFrame([(text, doc in clean) for doc, text in rows], "text string, target boolean").repartition(3)
    models = quality.fit_models(given)
    pairs, texts = [Counter(), Counter()], [Counter(), Counter()]
    for doc, text in rows:
        p, t = quality.features(text)
        for side in (0, 1) if doc in clean else (0,):
            pairs[side].update(p.tolist())
            texts[side].update(t.tolist())
    for doc, text in rows:
        p, t = (x.tolist() for x in quality.features(text))
        own, target, size = Counter(p), doc in clean, [c.total() for c in (*pairs, *texts)]
        ratio = lambda t, r, share: math.log((t + 1) / (r * share + 1))
        mean = sum(ratio(pairs[1][b] - target * own[b], pairs[0][b] - own[b], size[1] / size[0]) for b in p) / len(p)
        low = min(ratio(texts[1][b] - target, texts[0][b] - 1, size[3] / size[2]) for b in t)
        assert np.allclose(models.ratios(text, target), (mean, low))


def test_held_out_documents(spark, frame):
    rows, labels = corpus(900)
    given = spark.createDataFrame([x[:3] for x in labels if x[0] % 3], NO_LABELS)
    kept = {r.id for r in quality.resample(frame(rows), given).where("kept").collect()}
    held = [(doc in kept, kind) for doc, _, _, kind in labels if doc % 3 == 0]
    assert sum(k for k, kind in held if kind == "clean") >= 0.97 * sum(kind == "clean" for _, kind in held)
    assert sum(k for k, kind in held if kind != "clean") <= 0.05 * sum(kind != "clean" for _, kind in held)


def test_defined_results(spark, frame):
    rows = [(1, "a b c"), (2, None), (3, " "), (None, "x y"), (1, "a b c"), (1, "other")]
    none = spark.createDataFrame([], NO_LABELS)
    found = quality.resample(frame(rows), none).collect()
    assert sorted((str(r.id), r.weight, r.kept) for r in found) == [
        ("1", 0.0, True), ("1", 0.0, True), ("1", 0.0, True), ("2", None, False), ("3", None, False), ("None", 0.0, True)
    ] or {r.weight for r in found} == {0.0, None}
    assert quality.resample(frame([]), none).collect() == []
    kept = quality.keep_drawn(frame(rows), none)
    assert kept.columns == frame(rows).columns and kept.count() == 4
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (2, None, None)], NO_LABELS)
    marks = {r.label_id: (r.clean, r.toxic) for r in quality.labelled(odd).collect()}
    assert marks == {1: (False, False), 2: (False, False)}
    many = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert 300 < quality.labelled(many, 500).count() <= 560


def test_gumbel_draws_k(spark, frame):
    rows = [(k, f"w{k % 50} x") for k in range(400)]
    none = spark.createDataFrame([], NO_LABELS)
    drawn = [{r.id for r in quality.resample(frame(rows), none, k=37, seed=s).where("kept").collect()} for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and {len(d) for d in drawn} == {37}


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "LOOKED_AT", 5)
    monkeypatch.setattr(quality, "BARS", 7)
    values = [R.choice([R.random(), R.random() * 1e-9, 5.0, -1e300, 1e12]) for _ in range(600)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 333, 599, 600):
        assert quality.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
