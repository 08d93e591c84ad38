"""Operator 9, benchmark decontamination: a distributed positional inverted index of the corpus.

``build`` stores, for every segment of about ``segment_words`` corpus words, a sorted term dictionary
with the term counts and the delta-coded positions of every word: the whole index, not only what a
given benchmark asks for. Documents stand one empty position apart, so no match runs across two.

``matches`` takes benchmark texts in blocks of bounded size. In a segment, a window of terms is looked
up from its rarest term there: its positions less its offset in the window are candidates, and the
offset-adjusted lists of the other terms, by rising frequency, thin them out until none or only true
occurrences are left. Windows with an absent term go first. ``proximity`` finds texts whose terms all
occur within a span of words, in any order, from the same index.

A segment is one row, so a search is a map over the index without a shuffle. Only hits are shuffled.

Defined results: null text has no words; a text without words is never hit and an item without words
never occurs; an item with fewer words than a window is one window; rows that repeat an item id count
as one item; hits of items without an id count, but such items are not listed; rows that repeat a
document id share their hits' items and are counted apart; an empty table on either side gives rows
without hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectorpulse.llm.common import LARGE_ROWS, Memo, own_memos, text_or_empty, without, written

WINDOW = 13
SEGMENT_WORDS = 1 << 19
#: Characters of benchmark texts that a search holds at a time.
BLOCK_CHARS = 16_000_000

#: The bytes [\x00-\x2F\x3A-\x60\x7B-\x7F] separate words once A-Z are lower-cased.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


@cache
def _terms() -> Memo:
    return Memo(lambda word: int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True))


def terms(text: str) -> np.ndarray:
    """The words of ``text`` as 64-bit term numbers."""
    found = words(text)
    return np.fromiter(map(_terms().__getitem__, found), np.int64, len(found))


def _varints(values: np.ndarray) -> bytes:
    """Unsigned integers below 2^35, seven bits a byte; the high bit says that more follow."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >= (1 << bits)
    out = np.zeros(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    for k in range(5):
        more = sizes > k
        left = values[more] >> (7 * k)
        out[at[more] + k] = (left & 127) | np.where(sizes[more] > k + 1, 128, 0)
    return out.tobytes()


def _from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


INDEX = "segment long, doc_ids array<long>, doc_words array<long>, terms binary, counts binary, postings binary"


def _segment(name: int, ids: list, found: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in found], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    positions = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
    every = np.concatenate(found)
    order = np.argsort(every, kind="stable")
    every, positions = every[order], positions[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(every)))
    deltas = np.diff(positions, prepend=0)
    deltas[first] = positions[first]
    row = [[name], [ids], [sizes.tolist()], [every[first].tobytes()], [_varints(counts)], [_varints(deltas)]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)],
        ["segment", "doc_ids", "doc_words", "terms", "counts", "postings"],
    )


def build(
    docs: DataFrame, segment_words: int = SEGMENT_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The index of ``docs``, a row for each segment, written to the shared folder."""

    def segments(batches) -> Iterator[pa.RecordBatch]:
        own_memos("decontaminate")
        ids, found, held = [], [], 0
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                found.append(terms(text.as_py()))
                held += len(found[-1]) + 1
                if held >= segment_words:
                    yield _segment(name, ids, found)
                    ids, found, held, name = [], [], 0, name + 1
        if ids:
            yield _segment(name, ids, found)

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    return written(rows.mapInArrow(segments, INDEX), "corpus-index", **LARGE_ROWS)


class Segment:
    """The part of a segment's index that a block of benchmark terms needs."""

    def __init__(self, row: dict, wanted: np.ndarray):
        own = np.frombuffer(row["terms"], np.int64)
        counts = _from_varints(row["counts"])
        at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
        here = own[at] == wanted if len(own) else np.zeros(len(wanted), bool)
        self.counts = np.where(here, counts[at], 0) if len(own) else np.zeros(len(wanted), np.int64)
        ends = np.cumsum(counts)
        self._deltas = _from_varints(row["postings"])
        self._from = np.where(here, (ends - counts)[at], 0) if len(own) else self.counts
        self._held: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        """The positions of the ``term``-th wanted term, ascending."""
        if term not in self._held:
            lo = self._from[term]
            self._held[term] = np.cumsum(self._deltas[lo : lo + self.counts[term]])
        return self._held[term]

    def phrase(self, phrase: np.ndarray) -> np.ndarray:
        """Where the wanted terms of ``phrase`` occur one after another."""
        order = np.argsort(self.counts[phrase], kind="stable")
        found = self.positions(phrase[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.positions(phrase[k])
            at = np.searchsorted(other, found + k)
            found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == found + k)]
        return found

    def near(self, starts: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rarest wanted term with all others within ``span`` words of one document."""
        order = np.argsort(self.counts, kind="stable")
        found = self.positions(order[0])
        doc = np.searchsorted(starts, found, "right") - 1
        close = np.zeros(len(found), bool)
        for lo in range(span):
            first = np.maximum(found - lo, starts[doc])
            end = np.minimum(found - lo + span, (starts + sizes)[doc])
            ok = np.ones(len(found), bool)
            for term in order[1:]:
                other = self.positions(term)
                ok &= np.searchsorted(other, end) > np.searchsorted(other, first)
            close |= ok
        return found[close], doc[close]


def _blocks(items: DataFrame, block_chars: int, item_column: str, text_column: str) -> Iterator[list]:
    """The benchmark in blocks of about ``block_chars`` characters; one at a time is on the driver."""
    rows = items.select(F.col(item_column).cast("string").alias("item"), text_or_empty(text_column).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // block_chars
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()


FOUND = "segment long, place long, item string, first long, last long"


def _search(texts: list, window: int) -> Callable:
    """A map over segments: merged hit ranges of every item in every document."""
    found = [(row["item"], terms(row["text"])) for row in texts]
    found = [(item, t) for item, t in found if len(t)]
    wanted, places = np.unique(np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64), return_inverse=True)
    cuts = np.cumsum([0, *(len(t) for _, t in found)])
    items = [(found[k][0], places[cuts[k] : cuts[k + 1]]) for k in range(len(found))]

    def search(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment, hits = Segment(row, wanted), []
                ids, sizes = row["doc_ids"], np.array(row["doc_words"], np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                for item, t in items:
                    length = min(window, len(t))
                    # A window is possible where none of its terms is absent.
                    absent = np.cumsum(np.append(0, segment.counts[t] == 0))
                    at = []
                    for w in np.flatnonzero(absent[length:] == absent[:-length]):
                        at.append(segment.phrase(t[w : w + length]))
                    at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
                    if not len(at):
                        continue
                    doc = np.searchsorted(starts, at, "right") - 1
                    new = np.append(True, (np.diff(at) > length) | (np.diff(doc) != 0))
                    lo = np.flatnonzero(new)
                    hi = np.append(lo[1:] - 1, len(at) - 1)
                    for a, b in zip(lo, hi, strict=True):
                        d = doc[a]
                        hits.append((item, at[a] - starts[d], at[b] + length - 1 - starts[d], int(d)))
                if hits:
                    name, first, last, d = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"]] * len(d), pa.int64()),
                            pa.array(d, pa.int64()),
                            pa.array(name, pa.string()),
                            pa.array(first, pa.int64()),
                            pa.array(last, pa.int64()),
                        ],
                        ["segment", "place", "item", "first", "last"],
                    )

    return search


def matches(
    index: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """(segment, place, item, first, last): ranges of words that windows of an item cover."""
    blocks = _blocks(items, block_chars, item_column, text_column)
    found = [written(index.mapInArrow(_search(block, window), FOUND), "benchmark-hits") for block in blocks]
    return reduce(DataFrame.union, found)


def proximity(index: DataFrame, text: str, span: int) -> DataFrame:
    """(segment, place, item, first, last): where all words of ``text`` occur within ``span`` words.

    ``item`` is the text; first and last are the place of its rarest word.
    """
    wanted = np.unique(terms(text))

    def search(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, wanted)
                if not len(wanted) or (segment.counts == 0).any():
                    continue
                sizes = np.array(row["doc_words"], np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                at, doc = segment.near(starts, sizes, span)
                if len(at):
                    n = len(at)
                    columns = [np.full(n, row["segment"]), doc, pa.array([text] * n), at - starts[doc], at - starts[doc]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["segment", "place", "item", "first", "last"])

    return index.mapInArrow(search, FOUND)


def mark(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    share: int = 20,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    segment_words: int = SEGMENT_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(segment, place, id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A text is contaminated if one word in ``share`` or more is inside an occurring window.
    """
    index = build(docs, segment_words, id_column, text_column)
    hits = matches(index, items, window, block_chars, item_column, text_column)
    each = F.posexplode(F.arrays_zip("doc_ids", "doc_words"))
    rows = index.select("segment", each.alias("place", "doc"))
    rows = rows.select("segment", F.col("place").cast("long").alias("place"), "doc.doc_ids", "doc.doc_words").toDF(
        "segment", "place", "id", "n_words"
    )
    # The union of a document's ranges: what each one adds beyond the furthest end before it.
    before = Window.partitionBy("segment", "place").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1)))
    added = F.greatest(F.lit(0), F.col("last") - reached)
    of_docs = (
        hits.withColumn("added", added)
        .groupBy("segment", "place")
        .agg(F.sum("added").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    hit = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    return rows.join(of_docs, ["segment", "place"], "left").select(
        "segment",
        "place",
        "id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated.

    Equal texts are hit alike, so rows are named by a 64-bit hash of their text; ids play no part.
    """
    keyed = docs.withColumn("__key", F.xxhash64(text_or_empty(text_column)))
    marked = mark(keyed, items, id_column="__key", text_column=text_column, **options)
    bad = marked.where("contaminated").select(F.col("id").alias("__key")).distinct()
    return without(keyed, bad, "__key").drop("__key").select(*docs.columns)
