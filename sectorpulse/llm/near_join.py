"""Operator 6, n-gram Jaccard join by PartEnum signatures: every link, no pair of unlike texts lost.

A document's set is that of its distinct word shingles. Two sets of sizes a and b with Jaccard
similarity of at least t % differ in at most (a + b)(100 - t) / (100 + t) shingles. Sizes fall into
bands whose ends differ by that factor, so similar sets are in one band or in neighbouring ones; a set
signs for its own band's level and for the next one. A level with at most k differences hashes the
shingle domain into a little more than (k + 1) / 2 groups of three parts each and enumerates the subsets
of two parts of every group: a signature is the hash of the shingles of such a subset. Of sets that
differ in k places some group holds one difference at most, so two of its three parts agree and the
sets share the signature of these two. A subset without a shingle says nothing and is left out: in a
group with at least two non-empty parts no subset is empty, and a set with more than k / 2 such groups
has one that must agree. The few that have not sign again with other groups, together (two sets that
are both short of groups meet there, any other pair meets before), and in a last instance with their
empty subsets too.

Equal sets are one class, and only classes are compared. Most have no partner, and a smaller table says so
before anything is signed: similar sets of sizes a and b have at least t % of the larger one in common, so
the smallest common hashes of both lie among the first (100 - t) % of either, and the next few common
ones among as many more. A class joins in only if enough of those first hashes occur in other classes,
which drops texts that share a few lines with others, and never a link. Then:

1. In every bucket of equal signatures all classes are compared with the smallest one.
2. Links found make components. Only buckets that still hold several components matter further.
3. There, classes of different components are compared. A sketch of 512 parity bits comes first: each
   differing shingle flips one bit, so sets whose sketches differ in more bits than the threshold
   allows have no link. This is a bound, not a guess, and it is part of the join condition. A pair that
   meets in many buckets is named by few of them: each row carries the preceding signatures of its
   class (in the order of signatures), and a bucket passes over pairs that share one of those, since
   they have met there.

Pairs to compare also pass wider sketches, which grow with the sets, before their texts are fetched.

So a group of near copies costs a comparison for each signature and member instead of all pairs, and
every decision is made on the whole texts. Signatures stream from the tasks into one shuffle.

Shingles are 64-bit hashes; two texts are compared by theirs alone, so a wrong answer needs a collision
within one pair of texts. Classes have 64-bit names as well.

Defined results: null and empty texts have no shingles, are linked with nothing and keep their own id;
a text with fewer words than a shingle is one shingle; an empty table gives an empty result; rows that
repeat an id, or whose id is null, are compared by their own texts; a null id never names a component
that has another one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorpulse.llm.common import Memo, own_memos, sorted_unique, text_or_empty, without, written
from sectorpulse.llm.components import components

SHINGLE = 5
PERCENT = 80
SKETCH_LONGS = 8
#: Ids that are broadcast at most to pick texts (about 100 MB); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
INSTANCES = 3
#: Parts of a group, and the two parts of each of its subsets.
PARTS, FIRST, SECOND = 3, [0, 0, 1], [1, 2, 2]
#: One in so many of the hashes a partner must have in common is asked for beyond the first.
FURTHER = 20
#: Preceding signatures of its class that a row of a mixed bucket carries.
PRECEDING = 16

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)
_MIX2 = U64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * _MIX2
    h = (h ^ (h >> U64(27))) * _MIX
    return h ^ (h >> U64(31))


@cache
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of ``text``; A-Z are lower-cased."""
    words = text.encode().lower().split()
    h = np.fromiter(map(_word_hashes().__getitem__, words), U64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    rolled = np.full(n, width, U64)
    for j in range(width):
        rolled = (rolled ^ (rolled >> U64(29))) * _MIX + h[j : j + n]
    return sorted_unique(_mixed(rolled))


class Levels:
    """Bands of set sizes with their number of allowed differences and of parts."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [0]

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            first = self.ends[-1] + 1
            self.ends.append(max(first, 100 * first // self.percent))
        return int(np.searchsorted(self.ends, size))

    def differences(self, level: int) -> int:
        while len(self.ends) <= level:
            self.band(self.ends[-1] + 1)
        return 2 * self.ends[level] * (100 - self.percent) // (100 + self.percent)

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """The signatures of a set of sorted hashes."""
        band = self.band(len(hashes))
        return np.concatenate([self._level(hashes, level) for level in (band, band + 1)])

    def _level(self, hashes: np.ndarray, level: int) -> np.ndarray:
        k = self.differences(level)
        groups = (k + 1) // 2 + 2
        out = []
        for instance in range(INSTANCES):
            if instance:
                hashes = np.sort(_mixed(hashes + U64(instance)))
            salt = np.atleast_1d(U64((level << 40) + (instance << 36))) * _MIX
            if k == 0:
                return _mixed(_mixed(hashes ^ salt).sum(keepdims=True) + salt)
            parts = ((hashes >> U64(32)) * U64(groups * PARTS)) >> U64(32)
            starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            sums, filled = np.zeros(groups * PARTS, U64), np.zeros(groups * PARTS, bool)
            sums[parts[starts]] = np.add.reduceat(_mixed(hashes ^ salt), starts)
            filled[parts[starts]] = True
            sums, filled = sums.reshape(groups, PARTS), filled.reshape(groups, PARTS)
            places = np.arange(sums.size, dtype=U64).reshape(sums.shape)
            found = _mixed(sums[:, FIRST] + sums[:, SECOND] + places * _MIX2 + salt)
            says = filled[:, FIRST] | filled[:, SECOND]
            enough = 2 * np.count_nonzero(filled.sum(axis=1) >= 2) > k
            out.append(found[says] if enough or instance < INSTANCES - 1 else found.ravel())
            if enough:
                break
        return np.concatenate(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes & U64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _class(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big", signed=True)


SKETCH = [f"s{k}" for k in range(SKETCH_LONGS)]
CLASSES = "id long, n long, class long, wide binary, " + ", ".join(f"{s} long" for s in SKETCH)


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of a set, some two to four for each shingle."""
    width = 64 << max(3, (len(hashes) // 32).bit_length())
    bits = np.bincount(((hashes >> U64(20)) & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def flipped_bits(one: bytes, other: bytes) -> int:
    """Bits in which two wide sketches differ; the longer one is folded. No more than sets differ in."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (one, other)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _described(size: int) -> Callable:
    def describe(batches) -> Iterator[pa.RecordBatch]:
        own_memos("near_join")
        for batch in batches:
            n, names, rows, wide = [], [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), size)
                n.append(len(hashes))
                names.append(_class(hashes))
                rows.append(sketch(hashes))
                wide.append(wide_sketch(hashes))
            if n:
                sketches = np.array(rows)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(wide, pa.binary())]
                columns += [pa.array(sketches[:, k]) for k in range(SKETCH_LONGS)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "class", "wide", *SKETCH])

    return describe


def in_common(n: int, percent: int) -> int:
    """Hashes that a set of ``n`` has in common with a similar one at least."""
    return -(-percent * n // 100)


def asked(n: int, percent: int) -> int:
    """Hashes among the first ones of a set of ``n`` that a similar set has among its own first ones."""
    return 1 + in_common(in_common(n, percent), percent) // FURTHER


def first_hashes(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest of a set's sorted hashes.

    A set has at most n - c hashes that a similar one lacks (c in common at least), so its smallest m common
    ones are among its first n - c + m. Here m is 1 + c // FURTHER; of two similar sets the smaller one's m is
    at least what ``asked`` says for the larger one, as its size is c of the larger one or more.
    """
    common = in_common(len(hashes), percent)
    return hashes[: len(hashes) - common + 1 + common // FURTHER]


#: Signatures of one Arrow batch, and classes a task remembers to sign only once.
SIGNED_ROWS, SIGNED_CLASSES = 100_000, 1_000_000


def _joined(signatures: list[np.ndarray], names: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(x)) for x in (signatures, names)]
    return pa.RecordBatch.from_arrays(columns, ["sig", "class"])


def _signed(size: int, signatures: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """(sig, class): what ``signatures`` makes of the set of every class."""

    def sign(batches) -> Iterator[pa.RecordBatch]:
        own_memos("near_join")
        signed = set()
        found, names, held = [], [], 0
        for batch in batches:
            for text in batch.column(1):
                hashes = shingles(text.as_py(), size)
                name = _class(hashes) if len(hashes) else None
                if name is None or name in signed:
                    continue
                if len(signed) < SIGNED_CLASSES:
                    signed.add(name)
                found.append(signatures(hashes).view(np.int64))
                names.append(np.full(len(found[-1]), name))
                held += len(found[-1])
                if held >= SIGNED_ROWS:
                    yield _joined(found, names)
                    found, names, held = [], [], 0
        if found:
            yield _joined(found, names)

    return sign


def _allowed(percent: int) -> Callable:
    def allow(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("sizes", "left", "right")), strict=True)
            kept = [flipped_bits(a, b) * (100 + percent) <= sizes * (100 - percent) for sizes, a, b in rows]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return allow


def _compared(size: int, percent: int) -> Callable:
    def compare(batches) -> Iterator[pa.RecordBatch]:
        own_memos("near_join")
        last, one = None, None
        for batch in batches:
            linked = []
            for name, left, right in zip(batch.column("a"), batch.column("left"), batch.column("right"), strict=True):
                if name != last:
                    last, one = name, shingles(left.as_py(), size)
                other = shingles(right.as_py(), size)
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(other) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            if kept.num_rows:
                yield kept

    return compare


def _classed(size: int) -> Callable:
    def classed(batches) -> Iterator[pa.RecordBatch]:
        own_memos("near_join")
        for batch in batches:
            names = [_class(shingles(text.as_py(), size)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), batch.column("text"), batch.column("wanted")], ["class", "text", "wanted"]
            )

    return classed


def _pick(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(class, text) of one row for each class of ``ids`` (id, class)."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = ids.where("id IS NOT NULL").withColumnRenamed("class", "wanted")
    found = docs.join(F.broadcast(wanted) if small else wanted, "id").select("text", "wanted")
    # Where rows repeat an id, only those with the class's own set count.
    found = found.mapInArrow(_classed(size), "class long, text string, wanted long").where("class = wanted")
    # Rows without an id are found by their class.
    nameless = docs.where("id IS NULL").select("text", F.lit(0).cast("long").alias("wanted"))
    nameless = nameless.mapInArrow(_classed(size), "class long, text string, wanted long")
    nameless = nameless.join(ids.where("id IS NULL").select("class"), "class", "left_semi")
    return found.select("class", "text").union(nameless.select("class", "text")).dropDuplicates(["class"])


def _within(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches of two aliased classes allow a link."""
    sizes = F.col(f"{a}.n") + F.col(f"{b}.n")
    flipped = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH])
    return (
        (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n"))
        & (flipped * (100 + percent) <= sizes * (100 - percent))
    )


def _buckets(texts: DataFrame, size: int, signatures: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(sig, class, pivot) where several classes have a signature; the pivot is the smallest of them."""
    bucket = Window.partitionBy("sig")
    signed = texts.mapInArrow(_signed(size, signatures), "sig long, class long")
    both = signed.withColumns({"pivot": F.min("class").over(bucket), "top": F.max("class").over(bucket)})
    # A class whose copies several tasks met was signed by each.
    return both.where("pivot != top").select("sig", "class", "pivot").distinct()


def partners(texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, class) of the ``classes`` of ``texts`` whose first hashes allow a partner."""
    met = _buckets(texts, size, partial(first_hashes, percent=percent)).groupBy("class").agg(F.count("sig").alias("met"))
    least = F.udf(lambda n: asked(n, percent), "long")
    found = classes.join(met, "class").where(F.col("met") >= least("n"))
    return written(found.select("id", "class"), "near-partners")


def join(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; ids are whole numbers."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    described = written(texts.mapInArrow(_described(shingle), CLASSES), "near-classes")
    known = described.where("n > 0")
    classes = known.groupBy("class").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "wide", *SKETCH)])
    classes = written(classes, "near-reps")

    texts = written(_pick(texts, partners(texts, classes, shingle, percent), shingle), "near-texts")
    shared = written(_buckets(texts, shingle, Levels(percent).signatures), "near-buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that have a link: wide sketches first, then whole texts."""
        wide = classes.select("class", "n", "wide")
        x, y = wide.toDF("a", "n", "left"), wide.toDF("b", "m", "right")
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("n") + F.col("m")).alias("sizes"), "left", "right")
        pairs = written(pairs.mapInArrow(_allowed(percent), "a long, b long"), "near-pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        chosen = written(texts.join(needed, "class", "left_semi"), "near-chosen")
        held = pairs.join(chosen.toDF("a", "left"), "a").join(chosen.toDF("b", "right"), "b")
        return written(held.select("a", "b", "left", "right").mapInArrow(_compared(shingle, percent), "a long, b long"), "near-links")

    stars = shared.where("class != pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    stars = (
        stars.join(classes.alias("x"), F.col("a") == F.col("x.class"))
        .join(classes.alias("y"), F.col("b") == F.col("y.class"))
        .where(_within("x", "y", percent))
        .select("a", "b")
    )
    links = linked(stars)
    labels = components(links)

    # Buckets that still hold several components, with what their classes are compared by.
    named = shared.join(labels.toDF("class", "label"), "class", "left").select(
        "sig", "class", F.coalesce("label", "class").alias("label")
    )
    bucket = Window.partitionBy("sig")
    mixed = (
        named.withColumns({"low": F.min("label").over(bucket), "high": F.max("label").over(bucket)})
        .where("low != high")
        .select("sig", "class", "label")
    )
    before = Window.partitionBy("class").orderBy("sig").rowsBetween(-PRECEDING, -1)
    mixed = mixed.withColumn("before", F.collect_list("sig").over(before))
    mixed = written(mixed.join(classes.select("class", "n", *SKETCH), "class"), "near-mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    across = (
        (F.col("x.sig") == F.col("y.sig"))
        & (F.col("x.class") < F.col("y.class"))
        & (F.col("x.label") != F.col("y.label"))
        & _within("x", "y", percent)
        & ~F.arrays_overlap("x.before", "y.before")
    )
    rest = x.join(y, across).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    labels = components(links.union(linked(rest)))

    groups = known.join(labels.toDF("class", "label"), "class", "left").select(
        "id", "n", F.coalesce("label", "class").alias("label")
    )
    # Written, so that the join below has a shuffle of its own whose hot labels can be split.
    least = written(groups.groupBy("label").agg(F.min("id").alias("component_id")), "near-least")
    alone = described.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return groups.join(least, "label").select("id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component. Rows without an id stay."""
    joined = join(docs, shingle, percent, id_column, text_column)
    others = joined.where("id != component_id").select(F.col("id").alias(id_column)).distinct()
    return without(docs, others, id_column).select(*docs.columns)
