import random
from zlib import crc32

import numpy as np
import pytest

from sectorpulse.llm import toxicity

CLEAN = "river stone market window garden letter engine summer paper bridge morning doctor".split()
RUDE = ["idiot", "scum", "moron"]


def sentence(rng, n, rude=0):
    words = [rng.choice(CLEAN) + rng.choice(["", "s", "er", "ing"]) for _ in range(n)]
    for _ in range(rude):
        words[rng.randrange(n)] = rng.choice(RUDE)
    return " ".join(words)


def corpus(n=160, first=0):
    rng = random.Random(3)
    rows = []
    for k in range(first, first + n):
        label = int(k % 4 == 0)
        rows.append((k, sentence(rng, rng.randrange(20, 150), 4 * label), label))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(corpus(), steps=150)


def network():
    made = toxicity.Network.fresh(4, np.random.default_rng(0))
    made.p = {k: x.astype(np.float64) for k, x in made.p.items()}
    return made


def test_gradients_against_differences():
    net = network()
    ids, grams = np.array([0, 1, 2, 3, 0]), toxicity.Grams.of(["_", "abc", "de", "fgh", "xyz"])
    windows = np.array([[1, 2, 3, 4], [2, 3, 0, 1], [4, 0, 0, 2]])
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 1], [1, 0, 0, 1]], bool)
    label = np.array([1, 0, 1, 0.0])
    _, gradients = net.gradients(ids, grams, windows, mask, label)
    rng = np.random.default_rng(1)
    for name, x in net.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in x.shape)
            if name == "gram":
                at = (int(grams.slots[rng.integers(len(grams.slots))]), at[1])
            kept = x[at]
            x[at] = kept + 1e-4
            up = net.gradients(ids, grams, windows, mask, label)[0]
            x[at] = kept - 1e-4
            down = net.gradients(ids, grams, windows, mask, label)[0]
            x[at] = kept
            assert abs((up - down) / 2e-4 - gradients[name][at]) < 1e-6, name


def slow_logit(net, ids, words):
    """One window, one word at a time."""
    p, sig, h = net.p, lambda x: 1 / (1 + np.exp(-x)), toxicity.HIDDEN
    vectors = net.inputs(ids, toxicity.Grams.of(words))
    both = []
    for k, order in enumerate((range(len(words)), range(len(words) - 1, -1, -1))):
        state, seen = np.zeros(h), {}
        for t in order:
            x, g = vectors[t] @ p["W"][k] + p["b"][k, 0], state @ p["U"][k]
            z, r = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * g[2 * h :])
            state = (1 - z) * new + z * state
            seen[t] = state
        both.append([seen[t] for t in range(len(words))])
    states = np.hstack([np.array(x) for x in both])
    score = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
    share = np.exp(score) / np.exp(score).sum()
    return share @ states @ p["o"] + p["c"][0]


def test_windows_against_one_word_at_a_time():
    net = network()
    known = {w: k + 1 for k, w in enumerate(CLEAN[:4])}
    model = toxicity.Model(0.1, net, known)
    rng = random.Random(5)
    texts = [sentence(rng, n) for n in (1, 2, 31, 64, 65, 97, 200, 333)]
    best = toxicity.Scorer(model).logits([t.split() for t in texts])
    for text, found in zip(texts, best):
        words = text.split()
        cut = [words[s : s + toxicity.WINDOW] for s in toxicity.starts(len(words))]
        assert cut[-1][-1] == words[-1] and len(cut) == max(1, -(-(len(words) - 32) // 32))
        assert found == pytest.approx(max(slow_logit(net, [known.get(w, 0) for w in x], x) for x in cut), abs=1e-5)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 160, 161, 191, 192, 256, 257, 1000])
def test_blocks_have_the_windows_of_the_text(monkeypatch, n):
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 128)
    words = [f"w{k}" for k in range(n)]
    whole = {tuple(words[s : s + 64]) for s in toxicity.starts(n)}
    parts = {tuple(b[s : s + 64]) for b in toxicity.blocks(" ".join(words)) for s in toxicity.starts(len(b))}
    assert parts == whole


def test_long_texts_cost_bounded_memory_and_find_one_word(model, monkeypatch):
    rng = random.Random(9)
    long = sentence(rng, 60_000)
    rude = long[:200_000] + " idiot scum moron " + long[200_000:]
    monkeypatch.setattr(toxicity, "REMEMBERED", 100)
    one = toxicity.score_texts(model, [long, rude])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 4096)
    assert toxicity.score_texts(model, [long, rude]) == pytest.approx(one, abs=1e-4)
    assert one[1] > one[0] and toxicity.score_texts(model, ["x" * 3_000_000, " " * 3_000_000]).max() <= 1


def test_order_of_rows_does_not_matter(model):
    rows = corpus()
    again = toxicity.fit(rows[::-1], steps=150)
    texts = [t for _, t, _ in rows[:20]]
    assert (toxicity.score_texts(model, texts) == toxicity.score_texts(again, texts)).all()


def test_unseen_documents(model):
    rng = random.Random(77)
    clean, rude = [sentence(rng, 100) for _ in range(40)], [sentence(rng, 100, 4) for _ in range(40)]
    assert (toxicity.score_texts(model, clean) >= 0.5).mean() <= 0.1
    assert (toxicity.score_texts(model, rude) >= 0.5).mean() >= 0.8
    empty = toxicity.score_texts(model, [None, "", "..."])
    assert (empty >= 0).all() and len(set(empty)) == 1


def test_table(spark, frame, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 30)
    rows = corpus(80)
    docs = frame([(k, t) for k, t, _ in rows] + [(3, "again"), (3, "again"), (900, None), (901, ""), (None, "no id")])
    labels = [(k, x) for k, _, x in rows] + [(1, None), (None, 1), (7, 0), (9999, 1)]
    learned = spark.createDataFrame(labels, "doc_id long, toxic int")
    other = [(k, x if k is None or x is None or crc32(str(k).encode()) % 5 else 1 - x) for k, x in labels]
    turned = spark.createDataFrame(other, "doc_id long, toxic int")
    scores = []
    for table in (learned, turned):
        found = toxicity.score(docs, toxicity.train(docs, table)).collect()
        assert len(found) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in found)
        scores.append(sorted((r["id"] if r["id"] is not None else -1, r["score"]) for r in found))
    # Labels of held-out rows reach nothing.
    assert scores[0] == scores[1]


def test_labels_of_one_class_and_empty_tables(spark, frame):
    docs = frame([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(k, 0) for k in range(9)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    (score,) = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, one)).collect()}
    assert 0 < score < 0.5
    assert toxicity.score(frame([]), toxicity.train(frame([]), one)).collect() == []


def test_sample_is_bounded(spark, frame):
    docs = frame([(k, f"text {k}") for k in range(100)] + [(k, "copy") for k in range(50)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    known = toxicity.usable(labels, "doc_id")
    got = toxicity.sample(docs, known, "doc_id", per_class=10).collect()
    assert len(got) == 20 and len({r["doc_id"] for r in got}) == 20
    assert all(crc32(str(r["doc_id"]).encode()) % 5 for r in got)
