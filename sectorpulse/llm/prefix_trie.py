"""The trie of conversation prefixes: which conversations begin alike, how far, and what sharing saves.

A conversation is a path of turns; every distinct sequence of its first d turns is a node of depth d, named by
the folded digests of its turns (``scans``). Most prefixes belong to one conversation only, so a count-min
sketch of all prefix digests is built first: saturating two-bit counters, two bit planes of a fixed number of
cells, merged segment by segment and broadcast (``SKETCH_CELLS`` bounds it to 32 MB). An estimate of one proves
that a prefix is a singleton; estimates never fall below the truth. Such nodes, the tails of conversations, are
emitted where they are. Only prefixes that may be shared shuffle to be grouped exactly; a full sketch costs
shuffling, never exactness.

Sums over subtrees take no expansion to ancestors. Each node belongs to the chain of its smallest member. The
sum over a node's subtree is what all its members' chains hold, less what the chain of its own smallest member
holds above it: one group-by over member rows and one running sum along chains.

Defined results: turns are ordered by ``turn``, null first; equal turns by the digest of role and text. Null roles
and texts are empty. Rows without a conversation id belong to none. Without conversations there are no nodes;
a conversation without turns (only ``members`` can name one) is a member of the root that ends there. Repeated
rows are turns of their own. Very long texts are only hashed and counted, a very long conversation is scanned
by many tasks. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import written
from sectorpulse.llm.scans import SEED_KEY, scan

SKETCH_ROWS, SEGMENT = 4, 1 << 16
#: Cells of a row of the sketch: the power of two above four times the prefixes, between these bounds.
LEAST_CELLS, SKETCH_CELLS = 1 << 16, 1 << 25
#: Odd multipliers that give each row of the sketch its own hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
WORDS = r"[^\x20\x09-\x0D]+"


# -- turns -----------------------------------------------------------------------------------------


def turn_rows(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(group, turn, digest, words): turns without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length keeps role and text apart.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("group"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )


def numbered(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(group, turn, digest, words, index): each turn with its place in its conversation, from 0."""
    return scan(turn_rows(turns, conversation, turn), ["turn", "digest"]).drop("before", "last")


# -- the sketch ------------------------------------------------------------------------------------


def _cells(keys: pa.Array, width: int) -> list[np.ndarray]:
    """The cell of each key (16 bytes) in each row of the sketch."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = [(raw[:, 0] * np.uint64(m) ^ raw[:, 1]) * np.uint64(m) >> np.uint64(32) for m in MIX]
    return [(x % np.uint64(width)).astype(np.int64) for x in mixed]


def _add(planes: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """Add counters (bit planes "seen" and "seen twice or more") to others."""
    planes[1] |= twice | (planes[0] & once)
    planes[0] |= once


def sketch(keys: DataFrame, width: int) -> np.ndarray:
    """(row of the sketch, plane, packed cells) of the column ``key``."""
    segment = min(SEGMENT, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for row, cells in enumerate(_cells(batch.column("key"), width)):
                cells, n = np.unique(cells, return_counts=True)
                owner = cells // segment
                for k in np.unique(owner):
                    some, many = cells[owner == k] % segment, n[owner == k]
                    bits = np.zeros((2, segment), bool)
                    bits[0, some], bits[1, some] = True, many > 1
                    once, twice = np.packbits(bits, axis=1)
                    _add(held.setdefault((row, int(k)), np.zeros((2, segment // 8), np.uint8)), once, twice)
        yield from _segments(held.items())

    def _segments(items) -> Iterator[pa.RecordBatch]:
        for (row, k), planes in items:
            yield pa.RecordBatch.from_pydict({
                "row": pa.array([row], pa.int32()), "part": pa.array([k], pa.int64()), "planes": pa.array([planes.tobytes()], pa.binary()),
            })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, planes = None, None
        for batch in batches:
            for row, part, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (row, part) != at:
                    if at is not None:
                        yield from _segments([(at, planes)])
                    at, planes = (row, part), np.zeros((2, segment // 8), np.uint8)
                _add(planes, *np.frombuffer(data, np.uint8).reshape(2, -1))
        if at is not None:
            yield from _segments([(at, planes)])

    ddl = "row int, part long, planes binary"
    parts = keys.select("key").mapInArrow(count, ddl).repartition("row", "part").sortWithinPartitions("row", "part")
    out = np.zeros((SKETCH_ROWS, 2, width // 8), np.uint8)
    # Bounded by SKETCH_CELLS, whatever the rows.
    for found in parts.mapInArrow(merge, ddl).toLocalIterator():
        at = found["part"] * segment // 8
        out[found["row"], :, at : at + segment // 8] = np.frombuffer(found["planes"], np.uint8).reshape(2, -1)
    return out


def _single(planes: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether the estimate of each key is one: some row has seen its cell once only."""
    single = np.zeros(len(keys), bool)
    for row, cells in enumerate(_cells(keys, planes.shape[2] * 8)):
        twice = planes[row, 1, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1
        single |= twice == 0
    return single


def screened(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` with ``single`` (the prefix is proven a singleton) and ``tail`` (its parent is as well)."""
    # Broadcasts are cut by this bound on cells.
    n = prefixes.count()
    width = LEAST_CELLS
    while width < min(4 * n, SKETCH_CELLS):
        width *= 2
    shared = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, parent = (_single(shared.value, batch.column(c)) for c in ("key", "parent"))
            tail = parent & (np.array(batch.column("index")) > 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own | tail), pa.array(tail)], [*batch.schema.names, "single", "tail"]
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(run, f"{ddl}, single boolean, tail boolean")


# -- the trie --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trie:
    """``nodes``: key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_ends, first_end (the smallest
    conversation that ends there), n_children, n_leaves, saved_tokens. ``ends``: (key, conv_id) of all
    conversations that end at nodes where several may."""

    nodes: DataFrame
    ends: DataFrame


def build(turns: DataFrame, members: DataFrame | None = None) -> Trie:
    """The trie of ``turns`` (group, turn, digest, words: see ``turn_rows``).

    ``members`` (group) names all conversations, those without turns too; by default those of ``turns``.
    """
    scanned = scan(turns, ["turn", "digest"], digest="digest")
    prefixes = written(scanned.select("group", "index", "words", "last", "key", "parent"), "trie-prefixes")
    rows = written(screened(prefixes), "trie-screened")
    depth = (F.col("index") + 1).alias("depth")
    ended = F.col("last").cast("long")

    # Nodes of one conversation: all but the parent's smallest member is known.
    alone = rows.where("single").select(
        "key", F.col("group").alias("conv_id"), depth, "parent", "tail", F.lit(1).cast("long").alias("n_convs"),
        ended.alias("n_ends"), F.when(F.col("last"), F.col("group")).alias("first_end"), F.lit(0).cast("long").alias("words"),
    )
    perhaps = rows.where("NOT single")
    grouped = perhaps.groupBy("key").agg(
        F.min("group").alias("conv_id"), F.min(depth).alias("depth"), F.min("parent").alias("parent"),
        F.lit(False).alias("tail"), F.count(F.lit(1)).alias("n_convs"), F.sum(ended).alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("group"))).alias("first_end"), F.min("words").alias("words"),
    )
    grouped = written(grouped, "trie-nodes")

    # What the chain of each conversation holds: tokens saved, and the leaf it leads to, if it is that leaf's first.
    saved = (F.col("n_convs") - 1) * F.col("words")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    held = grouped.select(F.col("conv_id").alias("group"), saved.alias("saved"), leaf.alias("leaf")).unionByName(
        alone.where("n_ends = 1").select(F.col("conv_id").alias("group"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    )
    chains = written(held.groupBy("group").agg(F.sum("saved").alias("saved"), F.max("leaf").alias("leaf")), "trie-chains")

    # Sums over members, and children of shared nodes, by one group-by.
    zero = F.lit(0).cast("long")
    sums = perhaps.select("group", "key").join(chains, "group").select("key", "saved", "leaf", zero.alias("child"))
    heads = grouped.select("parent").union(alone.where("NOT tail").select("parent"))
    sums = sums.unionByName(heads.select(F.col("parent").alias("key"), zero.alias("saved"), zero.alias("leaf"), F.lit(1).cast("long").alias("child")))
    sums = sums.groupBy("key").agg(*[F.sum(c).alias(f"sum_{c}") for c in ("saved", "leaf", "child")])

    # What the smallest member's chain holds above a node.
    along = grouped.select(F.col("conv_id").alias("group"), "depth", "key", saved.alias("saved"))
    above = scan(along, ["depth"], value="saved").select("key", F.col("before").alias("above"))

    full = grouped.join(sums, "key").join(above, "key").select(
        "key", "conv_id", "depth", "parent", "tail", "n_convs", "n_ends", "first_end",
        F.col("sum_child").alias("n_children"), F.col("sum_leaf").alias("n_leaves"),
        (F.col("sum_saved") - F.col("above")).alias("saved_tokens"),
    )
    ones = alone.select(
        "key", "conv_id", "depth", "parent", "tail", "n_convs", "n_ends", "first_end",
        (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
    )

    # The root's members are all conversations: plain totals, combined before they meet.
    everyone = prefixes.where("index = 0").select("group")
    named = everyone if members is None else members.select(F.col("group").cast("long").alias("group")).where("group IS NOT NULL").distinct()
    bare = named.join(everyone, "group", "left_anti") if members is not None else everyone.limit(0)
    bare = written(bare, "trie-bare")
    names = ["n_convs", "conv_id", "n_ends", "first_end", "saved_tokens", "n_leaves", "n_children"]

    def totals(rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.select(*[columns.get(n, F.lit(None)).cast("long").alias(n) for n in names])

    one, group = F.lit(1), F.col("group")
    top_heads = heads.where(F.col("parent") == F.lit(SEED_KEY))
    root = totals(named, n_convs=one, conv_id=group).unionByName(totals(bare, n_ends=one, first_end=group))
    root = root.unionByName(totals(chains, saved_tokens=F.col("saved"), n_leaves=F.col("leaf")))
    root = root.unionByName(totals(top_heads, n_children=one))
    smallest = {"conv_id", "first_end"}
    root = root.agg(*[(F.min(n) if n in smallest else F.coalesce(F.sum(n), zero)).alias(n) for n in names])
    root = written(root.where("n_convs > 0"), "trie-root")
    first = root.agg(F.min("conv_id")).first()[0]
    root = root.select(
        F.lit(SEED_KEY).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_ends", "first_end", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
    )

    # Parents: a tail's is its own conversation, a first turn's the root, others look it up.
    nodes = written(full.unionByName(ones), "trie-without-parents")
    top = F.col("depth") == 1
    known = nodes.where(F.col("tail") | top).withColumn(
        "parent_conv_id", F.when(top, F.lit(first).cast("long")).otherwise(F.col("conv_id"))
    )
    parents = grouped.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    looked = nodes.where(~F.col("tail") & ~top).join(parents, "parent", "left")
    # A parent that is no shared node is one of the conversation's own.
    looked = looked.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "first_end", "n_children", "n_leaves", "saved_tokens"]
    nodes = known.select(columns).unionByName(looked.select(columns)).unionByName(root.select(columns))
    ends = perhaps.where("last").select("key", F.col("group").alias("conv_id"))
    ends = ends.unionByName(bare.select(F.lit(SEED_KEY).alias("key"), F.col("group").alias("conv_id")))
    return Trie(nodes, ends)


# -- lists of ends ---------------------------------------------------------------------------------

#: Ids of one piece of a list.
PIECE = 1000


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of each node's ``conv_id``, ascending, as decimals joined by commas.

    Lists are joined piece by piece in many tasks; a last task hashes a node's pieces as they come.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece():
            return pa.RecordBatch.from_pydict({
                "key": pa.array([key], pa.binary()), "first": pa.array([ids[0]], pa.int64()),
                "ids": pa.array([",".join(map(str, ids))]),
            })

        for batch in batches:
            for k, x in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or len(ids) == PIECE):
                    yield piece()
                    ids = []
                key = k
                ids.append(x)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([running.hexdigest()])})

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if running is not None:
                        yield row()
                    key, running = k, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
        if running is not None:
            yield row()

    pieces = ends.select("key", "conv_id").orderBy("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "first").drop("first")
    return pieces.mapInArrow(digest, "key binary, ends_sha256 string")


def with_turns(nodes: DataFrame, turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``nodes`` with the ``digest`` of their last turn and its ``words`` (null at the root), from ``turns`` as given to ``build``."""
    at = scan(turns, ["turn", "digest"]).select(
        F.col("group").alias("conv_id"), (F.col("index") + 1).alias("depth"), "digest", "words"
    )
    return nodes.join(at, ["conv_id", "depth"], "left")


# -- heads borrowed from other conversations ----------------------------------------------------------


def rebuilt(turns: DataFrame, base: Column, n_head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (as of ``numbered``) of conversations whose first ``n_head`` turns are those of conversation ``base``.

    ``base`` and ``n_head`` (at most ``most``) are expressions of ``group``. Also returns all conversations (group).
    """
    turns = written(turns, "trie-turns")
    members = turns.select("group").distinct()
    heads = turns.where(F.col("index") < most).select(F.col("group").alias("base"), "index", "digest", "words")
    borrowed = members.select("group", base.alias("base"), n_head.alias("n_head")).join(heads, "base")
    borrowed = borrowed.where("index < n_head")
    own = turns.where(F.col("index") >= n_head)
    columns = ["group", F.col("index").alias("turn"), "digest", "words"]
    return borrowed.select(columns).unionByName(own.select(columns)), members
