"""Operator 8, substring de-duplication by content-defined anchors and windows of words.

A passage is a run of ``min_words`` whole words or more whose bytes, spaces included, stand between words
of another document too. Every such run consists of windows of exactly ``min_words`` words, so the windows
that several texts have give all passages, whatever else the texts around them share.

Comparing all windows would cost a row for each word. Each window therefore has an anchor: the least gear
hash over those of its word ends whose look-back lies inside the window. The anchor depends on the bytes of
the window only, so equal windows have equal anchors, and neighbouring windows mostly share one. Anchors
that several texts have are found by one aggregation, combined before the shuffle, and set bits in a table
of fixed size. Windows whose bit is set get a digest of 128 bits; they are grouped by it, again combined
before the shuffle, so a line that every document has is no hot group. Bits that meet by chance let windows
through that the grouping drops; no passage is lost by the table.

Equal texts are one text, named by a 64-bit hash: documents with copies have the whole text as their
passage if it is long enough. ``cut_points``, ``common_around`` and ``whole_words`` are helpers for chunks
and ranges that ``passages`` does not need.

Defined results: null and empty texts have no passages; an empty table gives an empty result; ids name
and order documents, so rows that repeat an id have their passages each; a null id orders last;
other columns are ignored (``cut`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectorpulse.llm.common import sorted_unique, text_or_empty, written

MIN_CHUNK, MAX_CHUNK = 16, 128
#: Bits of the gear hash that must be zero at an end; they depend on the last 16 bytes.
END_BITS = np.uint32(0xF800)
MIN_WORDS = 50

#: A fixed random number for each byte value, from the digest of the byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of the gear hash h = 2 h + GEAR[byte] at every byte."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        more = h[:-step] << np.uint32(step)
        h[step:] += more
    return h


def word_starts(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    return ~space & np.append(True, space[:-1])


def cut_points(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    marked = (np.flatnonzero((gear(raw) & END_BITS) == 0) + 1).tolist() if len(raw) else []
    ends, start = [], 0
    for end in marked:
        if end - start < MIN_CHUNK:
            continue
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if end - start >= MIN_CHUNK:
            start = end
            ends.append(end)
    while len(data) - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


#: Gear hashes of 64 bits: bit b depends on the last b + 1 bytes.
GEAR64 = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
LOOK_BACK = 64


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def anchors(data: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, anchors) of every window of ``min_words`` words; an anchor depends on its window's bytes only."""
    starts, ends = word_bounds(data)
    n = len(starts) - min_words + 1
    if n <= 0:
        return starts[:0], ends[:0], np.zeros(0, np.uint64)
    # The shortest window has ``min_words`` letters and the spaces between them.
    look_back = min(LOOK_BACK, 2 * min_words - 1)
    h = GEAR64[data]
    for step in (1, 2, 4, 8, 16, 32):
        more = h[:-step] << np.uint64(step)
        h[step:] += more
    h = h[ends - 1] & np.uint64((1 << look_back) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    # The least hash over the word ends from ``left`` to the window's last, by tables over powers of two.
    starts, last = starts[:n], np.arange(n) + min_words - 1
    left = np.searchsorted(ends, starts + look_back)
    level = np.frexp(last - left + 1)[1] - 1
    found = np.empty(n, np.uint64)
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        found[at] = np.minimum(h[left[at]], h[last[at] - (1 << k) + 1])
        h = np.minimum(h[: -(1 << k)], h[1 << k :])
    return starts, ends[last], found


def _anchored(min_words: int):
    def anchor(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted_unique(anchors(np.frombuffer(text.as_py().encode(), np.uint8), min_words)[2]) for text in batch.column("text")]
            if counts := [len(x) for x in found]:
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found).view(np.int64))], ["key", "anchor"])

    return anchor


#: Bits of the table of repeated anchors: 16 MB.
TABLE_BITS = 1 << 27
_BLOCK_BITS = 1 << 15


def anchor_table(repeated: DataFrame) -> np.ndarray:
    """A bit for each anchor's low bits; a fixed number of blocks reaches the driver."""
    bit = F.col("anchor").bitwiseAND(F.lit(TABLE_BITS - 1))
    blocks = repeated.groupBy(F.floor(bit / _BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(bit % _BLOCK_BITS).alias("bits"))
    table = np.zeros((TABLE_BITS // _BLOCK_BITS, _BLOCK_BITS // 8), np.uint8)
    for row in blocks.collect():
        table[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


WINDOWS = "id long, key long, word int, start int, end int, high long, low long"


def _windowed(min_words: int, shared):
    def window(batches) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows, parts, digests = [], [], []
            for k, text in enumerate(batch.column("text")):
                data = text.as_py().encode()
                starts, ends, found = anchors(np.frombuffer(data, np.uint8), min_words)
                bit = found & np.uint64(TABLE_BITS - 1)
                words = np.flatnonzero(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                if len(words):
                    starts, ends = starts[words], ends[words]
                    digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    parts.append((words, starts, ends))
                    rows.append(np.full(len(words), k))
            if rows:
                at = pa.array(np.concatenate(rows))
                arrays = [batch.column("id").take(at), batch.column("key").take(at)]
                arrays += [pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*parts, strict=True)]
                pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                arrays += [pa.array(np.ascontiguousarray(pair[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in WINDOWS.split(", ")])

    return window


def common_around(one: bytes, two: bytes, start: int, end: int, shift: int) -> tuple[int, int] | None:
    """The longest equal range around one[start:end] = two[start - shift:end - shift], if that is equal."""
    if one[start:end] != two[start - shift : end - shift]:
        return None
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    n = min(start, start - shift)
    before = np.flatnonzero(a[start - n : start] != b[start - shift - n : start - shift])
    left = start - n + (int(before[-1]) + 1 if len(before) else 0)
    n = min(len(a) - end, len(b) - end + shift)
    after = np.flatnonzero(a[end : end + n] != b[end - shift : end - shift + n])
    return left, end + (int(after[0]) if len(after) else n)


def whole_words(data: bytes, start: int, end: int) -> tuple[int, int, int]:
    """The range of the whole words in data[start:end], and their number."""
    space = np.append(np.append(True, _SPACE[np.frombuffer(data, np.uint8)]), True)
    first = np.flatnonzero(space[start : end + 1][:-1] & ~space[start + 1 : end + 1]) + start
    last = np.flatnonzero(~space[start + 1 : end + 1] & space[start + 2 : end + 2]) + start + 1
    if not len(first) or not len(last) or last[-1] <= first[0]:
        return start, start, 0
    return int(first[0]), int(last[-1]), int((first < last[-1]).sum())


def passages(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, key, start, end, n_words, other_id, later) of every passage that another document has too.

    Starts and ends are bytes. ``later`` says that earlier documents have every byte of the range, otherwise
    later ones (or others of the same id) have; a document can have a row of each kind for the same words.
    Overlapping passages of a kind are one; ``n_words`` counts the words of the range and ``other_id`` has a
    passage of it.
    """
    text = text_or_empty(text_column)
    keyed = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    anchored = keyed.select("key", "text").mapInArrow(_anchored(min_words), "key long, anchor long")
    texts_with = anchored.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    shared = docs.sparkSession.sparkContext.broadcast(anchor_table(texts_with.where("lo != hi").select("anchor")))
    windows = written(keyed.mapInArrow(_windowed(min_words, shared), WINDOWS), "windows")
    named = F.max(F.col("id").isNull()).alias("unnamed"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    holders = windows.groupBy("high", "low").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), *named)
    # Written, so that the joins below have shuffles of their own whose hot keys can be split.
    holders = written(holders.where("lo != hi").drop("lo", "hi"), "window-holders")
    held = windows.withColumn("words", F.lit(min_words)).join(holders, ["high", "low"]).drop("high", "low")

    # Copies of whole texts.
    n_words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    listed = written(keyed.select("id", "key", F.lit(0).alias("word"), F.lit(0).alias("start"), F.octet_length("text").alias("end"), n_words.alias("words")), "listed")
    copies = listed.groupBy("key").agg(*named, F.count(F.lit(1)).alias("copies"))
    copies = written(copies.where("copies > 1").drop("copies"), "text-copies")
    held = held.unionByName(listed.where(F.col("words") >= min_words).join(copies, "key"))

    # Null ids order last.
    before = F.coalesce(F.col("first_id") < F.col("id"), F.col("first_id").isNotNull())
    after = F.col("id").isNotNull() & (F.col("unnamed") | (F.col("last_id") > F.col("id")))
    last = F.when(~F.col("unnamed"), F.col("last_id"))
    earlier = F.struct(F.lit(True).alias("later"), F.col("first_id").alias("other_id"))
    other = F.struct(F.lit(False).alias("later"), last.alias("other_id"))
    sides = F.when(before & after, F.array(earlier, other)).when(before, F.array(earlier)).otherwise(F.array(other))
    every = held.select("id", "key", "word", "words", "start", "end", F.inline(sides))

    order = Window.partitionBy("id", "key", "later").orderBy("start", "end")
    apart = F.coalesce((F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    grouped = every.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(order))
    return grouped.groupBy("id", "key", "later", "passage").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("long").alias("n_words"),
        F.min("other_id").alias("other_id"),
    ).select("id", "key", "start", "end", "n_words", "other_id", "later")


def cut(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the passages that an earlier document has; every row stays."""
    found = passages(docs, id_column=id_column, text_column=text_column, **options).where("later")
    ranges = found.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    ranges = ranges.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "__cut").dropDuplicates(["__id", "__key"])
    keyed = docs.withColumn("__key", F.xxhash64(text_or_empty(text_column)))
    same = keyed["__key"].eqNullSafe(ranges["__key"]) & keyed[id_column].eqNullSafe(ranges["__id"])
    data = F.col(text_column).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cut", lambda c: c["end"]))
    ends = F.concat(F.transform("__cut", lambda c: c["start"]), F.array(F.octet_length(text_column).cast("long")))
    parts = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda p: F.substring(data, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"),
    )
    kept = F.when(F.col("__cut").isNull(), F.col(text_column)).otherwise(F.array_join(parts, ""))
    return keyed.join(ranges, same, "left").withColumn(text_column, kept).select(*docs.columns)
