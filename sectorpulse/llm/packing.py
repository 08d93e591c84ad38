"""Operator 5, best-fit packing: pieces of documents into as few fixed-size sequences as possible.

Best-fit decreasing looks at lengths only, and there are at most ``capacity`` of them. So the plan is
made for the histogram of lengths: a segment tree over remaining capacities finds the tightest open
sequence in logarithmic time, and a whole run of equal sequences takes its pieces at once. The result
is that of best-fit decreasing over all pieces, one by one; neither the histogram nor the plan grows
with the number of documents. Pieces are then numbered within their length (by task, so a length that
a third of all pieces share is no hot group) and look up their place in the plan.

Defined results: null text counts as empty, so its document is the end id alone; an empty table gives
an empty result; rows that repeat an id are packed each; other columns are ignored. Only a document
longer than ``capacity`` is cut, into full pieces and a last one that may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectorpulse.llm.common import own_memos, text_or_empty, written
from sectorpulse.llm.encoding import word_level

CAPACITY = 2048
END_ID = 0

PIECES = "id long, piece int, start long, length long, ids_crc32 long, task int, place long"
PACKED = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenSequences:
    """Open sequences by remaining capacity, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _add(self, room: int, n: int) -> None:
        node = self.width + room
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, room: int, first: int, n: int) -> None:
        if n:
            self.runs[room].append((first, n))
            self._add(room, n)

    def take(self, room: int) -> tuple[int, int]:
        first, n = self.runs[room].pop()
        self._add(room, -n)
        return first, n

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some open sequence has."""
        node = self.width + length
        if self.tree[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing of ``histogram`` (length -> pieces).

    For each length, runs of (first piece, first sequence, pieces in each sequence, offset there):
    the pieces of a length, in order, fill sequence after sequence.
    """
    room, sequences = OpenSequences(capacity), 0
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for length in sorted(histogram, reverse=True):
        left, first, runs = histogram[length], 0, []
        while left:
            tight = room.tightest(length)
            if tight is None:
                tight, start, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                start, n = room.take(tight)
            # Once a sequence holds a piece it is the tightest one, so it takes all that fit.
            each = tight // length
            full = min(n, left // each)
            if full:
                runs.append((first, start, each, capacity - tight))
                room.put(tight - each * length, start, full)
                first, left = first + full * each, left - full * each
            if left and full < n:
                runs.append((first, start + full, left, capacity - tight))
                room.put(tight - left * length, start + full, 1)
                first, left, full = first + left, 0, full + 1
            room.put(tight, start + full, n - full)
        found[length] = runs
    return found


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """A row for each piece, numbered within its length and task."""
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        own_memos("words")
        encode, task = word_level(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    rows.append((doc, k, start, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if rows:
                yield _batch(rows, PIECES)

    return docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).mapInArrow(cut, PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kinds[kind]) for values, (_, kind) in zip(zip(*rows, strict=True), names, strict=True)],
        [name for name, _ in names],
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_column, text_column), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = cut.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("place"))

    def place(batches):
        starts = {length: [r[0] for r in found] for length, found in runs.items()}
        for batch in batches:
            lengths, ranks = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            at = []
            for n, rank in zip(lengths, ranks, strict=True):
                lo, sequence, each, offset = runs[n][bisect_right(starts[n], rank) - 1]
                at.append((sequence + (rank - lo) // each, offset + (rank - lo) % each * n))
            if at:
                sequence, offset = zip(*at, strict=True)
                kept = [batch.column(x) for x in ("id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return numbered.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)
