"""Operator 3, quality by importance resampling: hashed n-gram models of target and raw text.

The target model counts the n-grams of documents labelled clean, the raw model those of all documents.
Both hash words, word pairs and word beginnings into the same ``BUCKETS`` buckets. A document's log
importance weight has two parts, each a log ratio of target to raw:

* the mean over its words and word pairs, by how often they occur (low for junk and odd text);
* the lowest over its words and word beginnings, by how many documents have them (low for a word that
  clean text avoids, however long the text around it).

A document's own counts are left out of both models, so labelled and other documents are weighed alike.
Labelled rows give each part an origin and a unit: the origin is where the share of rejected rows above
it plus ``CLEAN_COST`` times the share of clean rows below it is least. The weight is the lesser part.

Sampling is Gumbel top-k: the k documents with the largest weight / temperature + Gumbel noise are a
draw without replacement in proportion to the weights' exponentials. By default k is the number of
documents with a weight of zero or more. The noise is a hash of the row, so a repeated task draws alike,
and the k-th key is found by histograms that narrow, not by a sort.

Origins and units come from a hashed sample of ``LABELLED`` labelled ids at most; the models count all
labels, and the sampling covers all rows.

Defined results: a text without words (null, empty) has no weight and is never drawn; without clean
labels every text with words has weight 0; several labels of one id count as the worst; rows that repeat
id and text are drawn alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import BROADCAST_KEYS, Memo, own_memos, sorted_unique, text_or_empty, without, written

BUCKETS = 1 << 20
#: Lengths of the word beginnings that are features, besides whole words.
BEGINNINGS = (4, 5, 6)
LABELLED = 200_000
CLEAN_COST = 4.0
TEMPERATURE = 0.02
SEED = 1
#: Added to observed and expected counts.
SMOOTHING = 1.0

_BLOCK = 1 << 12
_KINDS = ("pair_raw", "text_raw", "pair_target", "text_target")


_PACK = struct.Struct(f"<{1 + len(BEGINNINGS)}i").pack


def _buckets(word: str) -> bytes:
    """The buckets of a word and of its beginnings, as 32-bit integers."""
    whole = xxhash.xxh3_64_intdigest(word) % BUCKETS
    size = len(word)
    parts = [xxhash.xxh3_64_intdigest(word[:n], n) % BUCKETS if size > n else whole for n in BEGINNINGS]
    return _PACK(whole, *parts)


#: Words a worker remembers, some 100 MB.
WORDS = 400_000


@cache
def _memo() -> Memo:
    return Memo(_buckets, WORDS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word and word pair, distinct buckets of words and word beginnings)."""
    words = text.lower().split()
    found = np.frombuffer(b"".join(map(_memo().__getitem__, words)), np.int32).reshape(-1, 1 + len(BEGINNINGS))
    one = found[:, 0].astype(np.uint32)
    pairs = (one[:-1] * np.uint32(0x9E3779B1) + one[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate([one, pairs]).astype(np.int32), sorted_unique(found.ravel())


#: Characters of texts counted at once.
BATCH_CHARS = 4_000_000


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """The counts of a task's texts in blocks of buckets; (text, is a target)."""
    own_memos("quality")
    counts = np.zeros((len(_KINDS), BUCKETS), np.int64)

    def add(held: list, target: int) -> None:
        for kind, part in enumerate(zip(*held, strict=True)):
            n = np.bincount(np.concatenate(part), minlength=BUCKETS)
            counts[kind] += n
            if target:
                counts[kind + 2] += n

    held: tuple[list, list] = ([], [])
    size = 0
    for batch in batches:
        for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = text.as_py()
            held[target].append(features(words))
            size += len(words)
            if size >= BATCH_CHARS:
                for k in (0, 1):
                    if held[k]:
                        add(held[k], k)
                held, size = ([], []), 0
    for k in (0, 1):
        if held[k]:
            add(held[k], k)
    yield from _blocks(counts)


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in range(BUCKETS // _BLOCK):
        part = counts[:, block * _BLOCK : (block + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "counts"])


def _summed(batches) -> Iterator[pa.RecordBatch]:
    """The sum of each block; a partition has all rows of its blocks and holds one sum for each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(data.as_py(), np.int64)
            sums[block] = sums[block] + part if block in sums else part
    for block, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "counts"])


COUNTS = "block long, counts binary"


@dataclass
class Models:
    """Counts by bucket and their totals, for the target and for all text."""

    counts: np.ndarray  # by kind and bucket
    pairs_share: float
    texts_share: float

    def ratios(self, text: str, target: bool) -> tuple[float, float] | None:
        """(mean, lowest) log ratio of ``text``, its own counts left out."""
        pairs, distinct = features(text)
        if not len(pairs):
            return None
        buckets, n = np.unique(pairs, return_counts=True)
        n = n.astype(np.float32)
        pair_raw, text_raw, pair_target, text_target = self.counts
        mean = self._log(pair_target[buckets] - target * n, pair_raw[buckets] - n, self.pairs_share)
        lowest = self._log(text_target[distinct] - target, text_raw[distinct] - 1, self.texts_share)
        return float((mean * n).sum() / n.sum()), float(lowest.min())

    @staticmethod
    def _log(target: np.ndarray, raw: np.ndarray, share: float) -> np.ndarray:
        return np.log((np.maximum(target, 0) + SMOOTHING) / (np.maximum(raw, 0) * share + SMOOTHING))


def fit_models(rows: DataFrame) -> Models:
    """The models of ``rows`` (text, target); a fixed number of blocks reaches the driver."""
    blocks = rows.select("text", F.col("target").cast("int")).mapInArrow(_counted, COUNTS)
    blocks = blocks.repartition("block").mapInArrow(_summed, COUNTS)
    counts = np.zeros((len(_KINDS), BUCKETS), np.int64)
    for row in blocks.collect():
        at = row["block"] * _BLOCK
        counts[:, at : at + _BLOCK] = np.frombuffer(row["counts"], np.int64).reshape(len(_KINDS), _BLOCK)
    pair_raw, text_raw, pair_target, text_target = (int(c.sum()) for c in counts)
    return Models(counts, pair_target / max(1, pair_raw), text_target / max(1, text_raw))


def verdicts(labels: DataFrame) -> DataFrame:
    """(label_id, clean, toxic) of every labelled id."""
    ids = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    return ids.where(F.col("label_id").isNotNull()).select(
        "label_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), (F.col("toxic") == 1).alias("toxic")
    )


def _in_sample(label: Column, n_labels: int, limit: int) -> Column:
    share = min(1.0, 0.98 * limit / max(1, n_labels))
    return F.shiftrightunsigned(F.xxhash64(label, F.lit("labelled")), 11) / float(1 << 53) < share


def labelled(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(label_id, clean, toxic) of a hashed sample of about ``limit`` labelled ids at most."""
    marks = verdicts(labels)
    return marks.where(_in_sample(F.col("label_id"), marks.count(), limit))


SCORED = "id long, key long, clean boolean, toxic boolean, mean double, lowest double"


def _scored(shared):
    def score(batches) -> Iterator[pa.RecordBatch]:
        own_memos("quality")
        counts, *shares = shared.value
        models = Models(counts.astype(np.float32), *shares)
        for batch in batches:
            clean = batch.column("clean").to_pylist()
            found = [models.ratios(t.as_py(), bool(c)) for t, c in zip(batch.column("text"), clean, strict=True)]
            parts = [pa.array([f and f[k] for f in found], pa.float64()) for k in (0, 1)]
            kept = [batch.column(x) for x in ("id", "key", "clean", "toxic")]
            yield pa.RecordBatch.from_arrays([*kept, *parts], [x.split()[0] for x in SCORED.split(", ")])

    return score


def origin(clean: np.ndarray, rejected: np.ndarray, cost: float = CLEAN_COST) -> tuple[float, float]:
    """(origin, unit) of a part of the weight, from its values for clean and for rejected rows."""
    if not len(clean):
        return -np.inf, 1.0
    unit = float(clean.std()) or 1.0
    if not len(rejected):
        return float(clean.min()), unit
    values = np.unique(np.concatenate([clean, rejected]))
    cuts = np.append((values[:-1] + values[1:]) / 2, values[-1] + unit)
    cuts = np.append(values[0] - unit, cuts)
    lost = np.searchsorted(np.sort(clean), cuts) / len(clean)
    missed = 1 - np.searchsorted(np.sort(rejected), cuts) / len(rejected)
    return float(cuts[np.argmin(missed + cost * lost)]), unit


#: Bars of a histogram, and keys that are looked at one by one.
BARS, LOOKED_AT = 4096, 10_000


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value of a column without nulls, by histograms that narrow."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        inside = rows.where(F.col(column).between(low, high))
        width = (high - low) / BARS
        if not width or low + width == low:
            return low
        bar = F.least(F.floor((F.col(column) - low) / width), F.lit(BARS - 1))
        bars = {r[0]: r[1:] for r in inside.groupBy(bar).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()}
        for b in sorted(bars, reverse=True):
            n, least, most = bars[b]
            if k <= n:
                break
            k -= n
        low, high = least, most
        if n <= LOOKED_AT:
            values = [r[0] for r in rows.where(F.col(column).between(low, high)).select(column).collect()]
            return sorted(values, reverse=True)[k - 1]


def gumbel(row: Column, seed: int) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(row, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def _row_key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(F.col(id_column), text_or_empty(text_column))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    labelled_rows: int = LABELLED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, key, mean, lowest, weight, gumbel_key, kept) of every row; ``key`` names id and text."""
    marks = written(verdicts(labels), "labels")
    n_labels = marks.count()
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"), _row_key(id_column, text_column).alias("key"))
    marked = rows.join(F.broadcast(marks) if n_labels <= BROADCAST_KEYS else marks, F.col("id") == F.col("label_id"), "left")
    # Written beyond a size, so that texts are shuffled once for both passes.
    rows = marked.drop("label_id") if n_labels <= BROADCAST_KEYS else written(marked.drop("label_id"), "marked-texts")
    models = fit_models(rows.select("text", F.coalesce("clean", F.lit(False)).alias("target")))
    # A fixed number of buckets: 32 MB.
    shared = docs.sparkSession.sparkContext.broadcast((models.counts, models.pairs_share, models.texts_share))
    scored = written(rows.select("id", "key", "clean", "toxic", "text").mapInArrow(_scored(shared), SCORED), "scored")

    known = scored.where("clean IS NOT NULL AND mean IS NOT NULL").where(_in_sample(F.col("id"), n_labels, labelled_rows)).select("clean", "toxic", "mean", "lowest").toPandas()
    clean, toxic = known[known.clean], known[known.toxic]
    mean_at, mean_unit = origin(clean["mean"].to_numpy(), known[~known.clean & ~known.toxic]["mean"].to_numpy())
    low_at, low_unit = origin(clean["lowest"].to_numpy(), toxic["lowest"].to_numpy())
    weight = F.least((F.col("mean") - mean_at) / mean_unit, (F.col("lowest") - low_at) / low_unit)
    if not len(clean):
        weight = F.when(F.col("mean").isNotNull(), 0.0)
    weighed = scored.withColumn("weight", weight)
    weighed = weighed.withColumn("gumbel_key", F.col("weight") / temperature + gumbel(F.col("key"), seed))
    drawn = weighed.where("weight IS NOT NULL")
    k = drawn.where("weight >= 0").count() if k is None else min(k, drawn.count())
    least = kth_largest(drawn, "gumbel_key", k) if k > 0 else float("inf")
    kept = F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))
    return weighed.select("id", "key", "mean", "lowest", "weight", "gumbel_key", kept.alias("kept"))


def keep_drawn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    drawn = resample(docs, labels, id_column=id_column, text_column=text_column, **options)
    gone = drawn.where("NOT kept").select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", _row_key(id_column, text_column))
    return without(keyed, gone, "__key").select(*docs.columns)
