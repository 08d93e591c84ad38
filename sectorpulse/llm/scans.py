"""Running totals along the rows of groups, with no group in one task.

Rows are range-partitioned by group and order, so that a group of a third of all rows spreads over many
tasks. Each task scans its own rows, and what a group carries from one task to the next is worked out
from one row a task (their number, not the data's, bounds what the driver sees).

A digest is folded into 16 bytes by maps x -> a * x + b modulo a prime of 127 bits, a and b taken from the
digest. Maps compose, so what a task has seen of a group is one map, whatever came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import written

PRIME = 2**127 - 1
#: Where every chain of digests begins: the key of an empty prefix.
SEED = 0x5EC7
SEED_KEY = SEED.to_bytes(16, "big")
ROWS = 16_384


def folded(key: int, digest: bytes) -> int:
    """The key after ``digest`` (32 bytes) follows."""
    a = int.from_bytes(digest[:16], "big") % (PRIME - 1) + 1
    return (a * key + int.from_bytes(digest[16:], "big")) % PRIME


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int | None]]:
    """Bounded slices, each with the group of the row that follows it in the task (None after the last)."""
    held = None
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows = batch.slice(k, ROWS)
            if held is not None:
                yield held, rows.column("group")[0].as_py()
            held = rows
    if held is not None:
        yield held, None


def _local(names: list[str], digest: str | None, value: str | None):
    """A scan of one task's rows: place, sum and map of the group so far, before and after each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        group, seq, index, total, a, b = None, 0, 0, 0, 1, 0
        for rows, following in _slices(batches):
            groups = rows.column("group").to_pylist()
            digests = rows.column(digest).to_pylist() if digest else [None] * len(groups)
            values = rows.column(value).to_pylist() if value else [0] * len(groups)
            out: list[list] = [[] for _ in range(8)]
            for g, after, d, v in zip(groups, [*groups[1:], following], digests, values):
                if g != group:
                    group, index, total, a, b = g, 0, 0, 1, 0
                before = a.to_bytes(16, "big") + b.to_bytes(16, "big")
                if d is not None:
                    m = int.from_bytes(d[:16], "big") % (PRIME - 1) + 1
                    a, b = m * a % PRIME, (m * b + int.from_bytes(d[16:], "big")) % PRIME
                now = a.to_bytes(16, "big") + b.to_bytes(16, "big")
                v = v or 0
                for column, x in zip(out, (task, seq, index, total, v, after not in (g, None), before, now)):
                    column.append(x)
                seq, index, total = seq + 1, index + 1, total + v
            types = [pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(n) for n in names] + [pa.array(c, t) for c, t in zip(out, types)],
                [*names, "task", "seq", "index", "before", "own", "turns", "map_before", "map_after"],
            )

    return run


def scan(rows: DataFrame, order: list[str], digest: str | None = None, value: str | None = None) -> DataFrame:
    """``rows`` (``group`` long and others) with where each stands in its group's order.

    Adds ``index`` (from 0), ``before`` (sum of ``value`` over earlier rows), ``last`` (no row follows), and with
    ``digest`` (32 bytes) ``key`` and ``parent`` (16 bytes): the folded digests up to the row, with and without it.
    Rows that are equal under ``order`` keep some order; null digests fold nothing, null values count 0.
    """
    spark = rows.sparkSession
    names = rows.columns
    # Equal rows are told apart, so that many of them do not share a range.
    told = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = told.orderBy("group", *[F.col(c).asc_nulls_first() for c in order], "tie").drop("tie")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    extra = "task int, seq long, index long, before long, own long, turns boolean, map_before binary, map_after binary"
    local = written(ordered.mapInArrow(_local(names, digest, value), f"{ddl}, {extra}"), "scan")

    edge = F.struct("group", "index", "before", "own", "map_after")
    tasks = local.groupBy("task").agg(
        F.min_by("group", "seq").alias("first"), F.max_by(edge, "seq").alias("end"), F.max("seq").alias("top")
    )
    carries, held, held_group = [], None, None
    edges = tasks.orderBy("task").collect()
    for k, row in enumerate(edges):
        end = row["end"]
        follows = k + 1 < len(edges) and edges[k + 1]["first"] == end["group"]
        count, total, key = held if held and row["first"] == held_group else (0, 0, SEED)
        carries.append((row["task"], row["first"], count, total, key.to_bytes(16, "big"), row["top"], not follows))
        if end["group"] != row["first"]:
            count, total, key = 0, 0, SEED
        a, b = (int.from_bytes(end["map_after"][k : k + 16], "big") for k in (0, 16))
        held = count + end["index"] + 1, total + end["before"] + (end["own"] or 0), (a * key + b) % PRIME
        held_group = end["group"]

    # One row a task.
    carried = spark.createDataFrame(
        carries, "task int, first long, c_index long, c_before long, c_key binary, top long, ends boolean"
    )
    following = F.col("group") == F.col("first")
    joined = local.join(F.broadcast(carried), "task").select(
        *names,
        (F.col("index") + F.when(following, F.col("c_index")).otherwise(0)).alias("index"),
        (F.col("before") + F.when(following, F.col("c_before")).otherwise(0)).alias("before"),
        (F.col("turns") | ((F.col("seq") == F.col("top")) & F.col("ends"))).alias("last"),
        "map_before", "map_after",
        F.when(following, F.col("c_key")).otherwise(F.lit(SEED_KEY)).alias("c_key"),
    )
    if digest is None:
        return joined.drop("map_before", "map_after", "c_key")
    return joined.mapInArrow(_keys(names), f"{ddl}, index long, before long, last boolean, key binary, parent binary")


def _keys(names: list[str]):
    def applied(maps: list[bytes], keys: list[bytes]) -> pa.Array:
        number = int.from_bytes
        out = [
            ((number(m[:16], "big") * number(k, "big") + number(m[16:], "big")) % PRIME).to_bytes(16, "big")
            for m, k in zip(maps, keys)
        ]
        return pa.array(out, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [*names, "index", "before", "last"]
        for batch in batches:
            carried = batch.column("c_key").to_pylist()
            keys = [applied(batch.column(c).to_pylist(), carried) for c in ("map_after", "map_before")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + keys, [*kept, "key", "parent"])

    return run
