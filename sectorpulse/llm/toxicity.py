"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is its words ``\\w{1,32}`` in lower case, cut into windows of 64 words that overlap by half. The
input of a word is its own vector (of a bounded vocabulary; other words share one) beside the mean vector
of its hashed character trigrams. A gated recurrent layer reads each window from both ends, attention
pools its states and a linear unit gives a logit. A document's score is the calibrated maximum over all
its windows, whatever its length.

Training takes a bounded sample (``TRAIN_DOCS`` labelled ids of each class in the order of a hash,
``DOC_WINDOWS`` windows of a document) and is one task; scoring is one map over all rows, without shuffle.
Windows of a toxic document without a toxic word are mislabelled at first; once the network has learned a
little, only those that it finds suspicious stay.

Defined results: a null or empty text has one window without words; very long texts are scored block by
block in bounded memory; rows that repeat an id are all scored; of labels that repeat an id the highest
counts, null labels do not; with labels of one class only (or none) every score is the smoothed share of
toxic labels. Of an id that documents repeat the text of smallest hash trains. Only text reaches a score.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import written

WORD = re.compile(r"\w{1,32}")
WINDOW, STRIDE = 64, 32
#: Labelled ids of each class that train at most, and windows of each of their documents.
TRAIN_DOCS, DOC_WINDOWS = 3000, 64
#: Words with a vector of their own at most, and documents of the sample that must hold one.
VOCABULARY, LEAST_DOCS = 20_000, 3
GRAMS = 4096
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 12, 8
STEPS, BATCH, RATE, WORD_DROPOUT = 600, 96, 0.01, 0.25
#: Windows that are scored at once, words whose projections a worker remembers, words of one block.
SCORED, REMEMBERED, BLOCK_WORDS = 2048, 60_000, 65_536


class Grams:
    """Hashed character trigrams of words, one after another: those of word k are ``slots[begin[k]:][:count[k]]``."""

    def __init__(self, slots: np.ndarray, count: np.ndarray):
        self.slots, self.count = slots, count
        self.begin = np.cumsum(count) - count

    @staticmethod
    def of(words: list[str]) -> Grams:
        """Of words that are not empty."""
        marks = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        count = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(count + 2) - count - 2
        at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        # Odd multipliers of a hash.
        mixed = (marks[at] * np.uint64(0x9E3779B1) + marks[at + 1]) * np.uint64(0x85EBCA77) + marks[at + 2]
        return Grams(((mixed * np.uint64(0xC2B2AE3D)) >> np.uint64(16)).astype(np.int64) % GRAMS, count)

    def take(self, words: np.ndarray) -> Grams:
        count = self.count[words]
        at = np.arange(count.sum()) + np.repeat(self.begin[words] - (np.cumsum(count) - count), count)
        return Grams(self.slots[at], count)

    def means(self, vectors: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vectors[self.slots], self.begin) / self.count[:, None].astype(vectors.dtype)


def starts(n_words: int) -> range:
    """Where the overlapping windows of a text begin; the last one holds its last word."""
    return range(0, max(n_words - WINDOW + STRIDE, 1), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


@dataclass
class Network:
    """``p``: word vectors (row 0: other words), gram vectors, input, recurrent, attention, output."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(n_words: int, rng: np.random.Generator) -> Network:
        e, h = WORD_DIM + CHAR_DIM, HIDDEN

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        p = {
            "word": normal(n_words + 1, WORD_DIM, scale=0.1),
            "gram": normal(GRAMS, CHAR_DIM, scale=0.1),
            "W": normal(2, e, 3 * h, scale=e**-0.5),
            "U": normal(2, h, 3 * h, scale=h**-0.5),
            "b": np.zeros((2, 1, 3 * h), np.float32),
            "A": normal(2 * h, ATTENTION, scale=(2 * h) ** -0.5),
            "a": np.zeros(ATTENTION, np.float32),
            "v": normal(ATTENTION, scale=ATTENTION**-0.5),
            "o": normal(2 * h, scale=(2 * h) ** -0.5),
            "c": np.zeros(1, np.float32),
        }
        return Network(p)

    def inputs(self, word_ids: np.ndarray, grams: Grams) -> np.ndarray:
        """Vectors of words from their ids and trigrams."""
        return np.hstack([self.p["word"][word_ids], grams.means(self.p["gram"])])

    def states(self, projected: Iterator[np.ndarray], mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, both states, window). ``projected``: inputs of (direction, gate, window), step by step."""
        steps, n = mask.shape
        h = np.zeros((2, HIDDEN, n), self.p["U"].dtype)
        out = np.empty((steps, 2 * HIDDEN, n), h.dtype)
        both = np.stack([mask, mask[::-1]], 1)[:, :, None]
        full = bool(mask.all())
        turned = np.ascontiguousarray(self.p["U"].transpose(0, 2, 1))
        for t, x in enumerate(projected):
            g = turned @ h
            inner = g[:, 2 * HIDDEN :]
            zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
            if keep is not None:
                keep.append((h, z, r, new, inner))
            moved = new + z * (h - new)
            h = moved if full else np.where(both[t], moved, h)
            out[t, :HIDDEN] = h[0]
            out[steps - 1 - t, HIDDEN:] = h[1]
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """Attention shares, their inner layer, pooled states and logits."""
        inner = np.tanh(self.p["A"].T @ states + self.p["a"][:, None])
        weight = np.where(mask, self.p["v"] @ inner, np.float32(-1e9))
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("thn,tn->hn", states, weight)
        return weight, inner, pooled, self.p["o"] @ pooled + self.p["c"][0]

    def logits(self, table: np.ndarray, windows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``table``: projected inputs of words (direction, word, gates). ``windows``: rows of it (time, window)."""
        last = len(windows) - 1
        steps = (np.stack([table[0][windows[t]].T, table[1][windows[last - t]].T]) for t in range(last + 1))
        return self.pool(self.states(steps, mask), mask)[3]

    def gradients(self, word_ids, grams, windows, mask, label) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients. ``windows`` (time, window) are places in ``word_ids`` and ``grams``."""
        p = self.p
        vectors = self.inputs(word_ids, grams)
        table = vectors[None] @ p["W"] + p["b"]
        steps, n = windows.shape
        order = np.stack([windows, windows[::-1]], 1)
        keep: list = []
        states = self.states((np.stack([table[0][w[0]].T, table[1][w[1]].T]) for w in order), mask, keep)
        weight, inner, pooled, logit = self.pool(states, mask)
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        d_logit = (sigmoid(logit) - label).astype(logit.dtype) / n
        out = {"o": pooled @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = p["o"][:, None] * d_logit
        d_states = weight[:, None] * d_pooled
        d_weight = np.einsum("thn,hn->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        out["v"] = np.tensordot(inner, d_score, ((0, 2), (0, 1)))
        d_inner = d_score[:, None] * p["v"][:, None] * (1 - inner**2)
        out["a"] = d_inner.sum((0, 2))
        out["A"] = np.tensordot(states, d_inner, ((0, 2), (0, 2)))
        d_states += p["A"] @ d_inner
        both = np.stack([mask, mask[::-1]], 1)[:, :, None]
        d_h = np.zeros((2, HIDDEN, n), states.dtype)
        d_x = np.empty((steps, 2, 3 * HIDDEN, n), states.dtype)
        out["U"] = np.zeros_like(p["U"])
        for t in reversed(range(steps)):
            before, z, r, new, g = keep[t]
            d_h[0] += d_states[t, :HIDDEN]
            d_h[1] += d_states[steps - 1 - t, HIDDEN:]
            d_moved = np.where(both[t], d_h, 0)
            d_new = d_moved * (1 - z) * (1 - new**2)
            d_z = d_moved * (before - new) * z * (1 - z)
            d_r = d_new * g * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_new * r], 1)
            d_x[t] = np.concatenate([d_z, d_r, d_new], 1)
            out["U"] += before @ d_g.transpose(0, 2, 1)
            d_h = d_h - d_moved + d_moved * z + p["U"] @ d_g
        d_table = np.empty_like(table)
        for k in range(2):
            places, flat = order[:, k].ravel(), d_x[:, k].transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
            d_table[k] = np.stack([np.bincount(places, x, len(word_ids)) for x in flat], 1)
        out["b"] = d_table.sum(1, keepdims=True)
        out["W"] = vectors.T[None] @ d_table
        d_vectors = (d_table @ p["W"].transpose(0, 2, 1)).sum(0)
        out["word"] = np.stack([np.bincount(word_ids, x, len(p["word"])) for x in d_vectors.T[:WORD_DIM]], 1)
        d_gram = np.repeat(d_vectors[:, WORD_DIM:] / grams.count[:, None], grams.count, 0)
        out["gram"] = np.stack([np.bincount(grams.slots, x, GRAMS) for x in d_gram.T], 1)
        return loss, out


class Adam:
    def __init__(self, network: Network):
        self.network, self.t = network, 0
        self.m = {k: np.zeros_like(x) for k, x in network.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in network.p.items()}

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        size = max(1.0, float(np.sqrt(sum((g**2).sum() for g in gradients.values()))))
        for k, x in self.network.p.items():
            g = (gradients[k] / size).astype(np.float32)
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            mean, square = self.m[k] / (1 - 0.9**self.t), self.s[k] / (1 - 0.99**self.t)
            x -= rate * mean / (np.sqrt(square) + 1e-6)


@dataclass
class Model:
    """A trained network with its vocabulary and calibration, or a constant ``share`` alone."""

    share: float
    network: Network | None = None
    vocabulary: dict[str, int] | None = None
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, logit: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(logit), self.share)
        return sigmoid(np.clip(self.slope * logit.astype(np.float64) + self.shift, -30, 30))


class Scorer:
    """Logits of windows under a model; remembers the projected inputs of a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for words."""
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            if len(rows) + len(new) > REMEMBERED:
                rows.clear()
                self.table = self.table[:, :1]
                new = list(dict.fromkeys(words))
            rows.update(zip(new, range(len(rows) + 1, len(rows) + 1 + len(new))))
            p, known = self.model.network.p, self.model.vocabulary
            ids = np.array([known.get(w, 0) for w in new])
            vectors = self.model.network.inputs(ids, Grams.of(new))
            self.table = np.concatenate([self.table, vectors[None] @ p["W"] + p["b"]], 1)
        return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The highest logit of the windows of each list of words."""
        words = [w for text in texts for w in text]
        places = np.append(self.places(words), np.zeros(WINDOW, np.int32))
        begin, length, owner, base = [], [], [], 0
        for k, text in enumerate(texts):
            for s in starts(len(text)):
                begin.append(base + s)
                length.append(min(WINDOW, len(text) - s))
                owner.append(k)
            base += len(text)
        begin, length, owner = np.array(begin), np.array(length), np.array(owner)
        best = np.full(len(texts), -np.inf, np.float32)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, range(SCORED, len(order), SCORED)):
            if len(part):
                span = np.arange(max(int(length[part].max()), 1))[:, None]
                mask = span < length[part]
                at = np.where(mask, places[np.minimum(begin[part] + span, len(places) - 1)], 0)
                np.maximum.at(best, owner[part], self.model.network.logits(self.table, at, mask))
        return best


def blocks(text: str) -> Iterator[list[str]]:
    """Words in blocks that overlap as windows do, so that the windows of all blocks are those of the text."""
    held: list[str] = []
    for found in WORD.finditer(text):
        held.append(found.group())
        if len(held) == BLOCK_WORDS + STRIDE:
            yield held
            held = held[BLOCK_WORDS:]
    # What is left of the block before has been in its last window, unless it is the whole text.
    if len(held) != STRIDE or len(text) < BLOCK_WORDS:
        yield held


def score_texts(model: Model, texts: Iterable[str | None], scorer: Scorer | None = None) -> np.ndarray:
    """Scores (0 to 1) of whole texts; many short ones share a pass, a long one takes several."""
    texts = [t or "" for t in texts]
    best = np.full(len(texts), -np.inf, np.float32)
    if model.network is None:
        return model.scores(best)
    scorer = scorer or Scorer(model)
    queue: list[list[str]] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if queue:
            np.maximum.at(best, owners, scorer.logits(queue))
        queue.clear(), owners.clear()
        size = 0

    for k, text in enumerate(texts):
        for words in [WORD.findall(text.lower())] if len(text) < BLOCK_WORDS else blocks(text.lower()):
            queue.append(words)
            owners.append(k)
            size += len(words) + WINDOW
            if size > BLOCK_WORDS:
                flush()
    flush()
    return model.scores(best)


def _calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the logits of documents, by damped Newton steps."""
    weight = weight * len(weight) / weight.sum()
    spread = max(float(logit.std()), 1e-3)
    x = np.stack([(logit - logit.mean()) / spread, np.ones(len(logit))], 1)
    w = np.array([1.0, np.log((weight @ label + 1) / (weight @ (1 - label) + 1))])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - label)) + [0.05 * w[0], 0]
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([0.05, 1e-3])
        w = w - np.clip(np.linalg.solve(hessian, g), -1, 1)
    slope = max(w[0], 0.05) / spread
    return float(slope), float(w[1] - slope * logit.mean())


def fit(rows: list[tuple[int, str, int]], totals: tuple[int, int] | None = None, steps: int = STEPS, seed: int = 1) -> Model:
    """A model from (doc_id, text, label) rows; a fifth of them calibrates and does not train the network.

    ``totals``: how many clean and toxic labels there are, if ``rows`` are a sample of other proportions.
    """
    rows = sorted(rows)
    labels = np.array([x[2] for x in rows], np.int64)
    sampled = np.bincount(labels, minlength=2)
    totals = sampled if totals is None else np.array(totals)
    share = (totals[1] + 1) / (totals.sum() + 2)
    calibrating = np.array([crc32(f"calibrate {x[0]}".encode()) % 5 == 0 for x in rows], bool)
    if len(rows) == 0 or min(np.bincount(labels[~calibrating], minlength=2)) == 0:
        return Model(float(share))
    rng = np.random.default_rng(seed)
    words = [WORD.findall(x[1].lower()) for x in rows]
    held = Counter(w for k, text in enumerate(words) if not calibrating[k] for w in set(text))
    common = sorted((-n, w) for w, n in held.items() if n >= LEAST_DOCS)[:VOCABULARY]
    vocabulary = {w: i + 1 for i, (_, w) in enumerate(common)}
    network = Network.fresh(len(vocabulary), rng)
    model = Model(float(share), network, vocabulary)

    places: dict[str, int] = {}
    windows, length, owner = [], [], []
    for k, text in enumerate(words):
        if calibrating[k]:
            continue
        taken = sorted(starts(len(text)), key=lambda s: crc32(f"{rows[k][0]} {s}".encode()))[:DOC_WINDOWS]
        for s in taken:
            window = [places.setdefault(w, len(places) + 1) for w in text[s : s + WINDOW]]
            length.append(len(window))
            windows.append(window + [0] * (WINDOW - len(window)))
            owner.append(k)
    windows, length, owner = np.array(windows, np.int32), np.array(length), np.array(owner)
    word_ids = np.array([0, *(vocabulary.get(w, 0) for w in places)])
    # Place 0 fills windows up and is masked.
    grams = Grams.of(["_", *places])
    positive, negative = np.flatnonzero(labels[owner] == 1), np.flatnonzero(labels[owner] == 0)
    hard = negative
    adam, span = Adam(network), np.arange(WINDOW)[:, None]
    for step in range(steps):
        if step in (steps // 3, 2 * steps // 3):
            positive, hard = _suspicious(network, word_ids, grams, windows, length, owner, labels)
        third = BATCH // 3
        part = np.concatenate([rng.choice(x, third) for x in (positive, negative, hard)])
        used, at = np.unique(windows[part].T, return_inverse=True)
        ids = np.where(rng.random(len(used)) < WORD_DROPOUT, 0, word_ids[used])
        mask = span < length[part]
        label = labels[owner[part]].astype(np.float32)
        _, gradients = network.gradients(ids, grams.take(used), at.reshape(WINDOW, -1), mask, label)
        adam.step(gradients, RATE * min(1.0, 2 * (1 - step / steps)))

    some = np.flatnonzero(calibrating)
    if len(some) == 0 or min(np.bincount(labels[some], minlength=2)) < 5:
        some = np.arange(len(rows))
    raw = Model(float(share), network, vocabulary)
    scorer = Scorer(raw)
    logit = np.concatenate([scorer.logits([words[k]]) for k in some])
    model.slope, model.shift = _calibrate(
        logit.astype(np.float64), labels[some], (totals / np.maximum(sampled, 1))[labels[some]]
    )
    return model


def _suspicious(network, word_ids, grams, windows, length, owner, labels) -> tuple[np.ndarray, np.ndarray]:
    """Windows of toxic documents that the network finds toxic (the first of each at least), and a sixteenth
    of the clean ones: those that it is most wrong about."""
    table = network.inputs(word_ids, grams)[None] @ network.p["W"] + network.p["b"]
    span = np.arange(WINDOW)[:, None]
    parts = np.split(np.arange(len(owner)), range(SCORED, len(owner), SCORED))
    logit = np.concatenate([network.logits(table, windows[x].T, span < length[x]) for x in parts])
    best = np.full(len(labels), -np.inf, np.float32)
    np.maximum.at(best, owner, logit)
    toxic = labels[owner] == 1
    clean = np.flatnonzero(~toxic)
    clean = clean[np.argsort(-logit[clean], kind="stable")]
    return np.flatnonzero(toxic & ((logit > 0) | (logit >= best[owner]))), clean[: max(len(clean) // 16, 1)]


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learned: the crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def usable(labels: DataFrame, id_column: str) -> DataFrame:
    """(doc_id, label) of the labels that may be learned, one row an id."""
    known = labels.select(F.col(id_column).alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, known: DataFrame, id_column: str, per_class: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, label) of the labelled sample: one row an id, ``per_class`` ids of each class at most."""
    drawn = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    chosen = written(drawn[0].union(drawn[1]), "toxicity-labels")
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class ids, whatever the tables' size.
    texts = texts.join(F.broadcast(chosen), "doc_id")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return texts.groupBy("doc_id").agg(first, F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", per_class: int = TRAIN_DOCS) -> Model:
    """Fit on the bounded sample, in one task; the driver gets the weights alone."""
    known = usable(labels, id_column)
    counts = dict(known.groupBy("label").count().collect())
    totals = (counts.get(0, 0), counts.get(1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(x.values()) for batch in batches for x in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows, totals))], pa.binary())})

    rows = written(sample(docs, known, id_column, per_class), "toxicity-sample")
    found = rows.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], totals)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row, in one map over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        scorer = Scorer(model) if model.network is not None else None
        for batch in batches:
            found = score_texts(model, batch.column("text").to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), "text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
