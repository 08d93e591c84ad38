"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often in a corpus.

Both tokenizers read a space followed by the text. Where a token of each ends at the same byte, a group
ends; inside a group every pair of tokens whose bytes overlap is a link. A pair of ids counts the documents
that hold it linked. A link is best if no other pair of its first id counts more.

Counting is external. A task radix-partitions the pair-document records of up to ``RUN_DOCS`` documents
by the low bits of the first id, sorts each part by (first id, second id, document) and emits it as a
zstd run: the pairs with their numbers of documents apart from the documents themselves. The pairs of
``FAN_IN`` runs at a time are merged by a heap of their heads until a part has one run; the last merge goes
through each first id's pairs side by side and so knows their maximum. Then every run's records pass its
part's counts, and the contributions to each document go back to the run, summed as arrays.

A frequent id is no hot task: runs hold a pair once with its number of documents, so what is merged
grows with runs and vocabularies, and records are read in slices of ``SLICE`` runs of a part. A merging
task holds ``FAN_IN`` compressed runs of one part and one opened block of each.

Defined results: null and empty texts, and texts whose joined token bytes differ from space and text (a
tokenizer that normalises, or a literal U+2581), have no tokens and zeros. Rows that repeat an id or a
text are documents of their own. Very long texts are read in blocks cut before blanks, where neither
tokenizer joins characters; a text without blanks is one block. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import Memo, own_memos, written
from sectorpulse.llm.encoding import LATIN_END, MARKS, ODD_SPACE

RUN_DOCS, RUN_RECORDS = 4096, 2_000_000
PARTS, FAN_IN, SLICE, BLOCK = 64, 64, 64, 16_384
#: Characters of a text that are encoded at once, at least; pieces a worker remembers, and their longest.
CUT, REMEMBERED, LONGEST = 32_768, 350_000, 40
#: Bits of an id of the second tokenizer in a pair.
SECOND_BITS = 20


# -- tokens ----------------------------------------------------------------------------------------


@cache
def byte_symbols() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin bytes are themselves, others follow from 256."""
    # The ranges of bytes that stand for themselves.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """``encode``: texts -> ids of space + text each. ``pieces``, ``sizes``: bytes of each id and their number."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.array(list(map(len, pieces)))
        # Decimals of ids with what may follow them.
        self.decimals = {mark: np.array([b"%d%s" % (i, mark) for i in range(len(pieces))], object) for mark in (b",", b"|", b";")}


@cache
def byte_level(path: str) -> Tokens:
    """A byte-level vocabulary of the tokenizers library; its special strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    symbols = byte_symbols()
    entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    pieces = [bytes(symbols[c] for c in e) if all(c in symbols for c in e) else e.encode() for e in entries]

    def encode(texts: list[str]) -> list[list[int]]:
        found = tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [x.ids for x in found]

    return Tokens(encode, pieces)


@cache
def pieces_level(path: str) -> Tokens:
    """A vocabulary of the sentencepiece library, which puts the space before a text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokens(lambda texts: model.encode(texts, num_threads=1), pieces)


class Aligned(NamedTuple):
    """What a text gives: numbers of tokens, groups and links, groups as text, linked pairs."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: bytes


def align(a: Tokens, b: Tokens, a_ids: list[list[int]], b_ids: list[list[int]], wholes: list[bytes]) -> list[Aligned | None]:
    """One for each of ``wholes``; None where the tokens' bytes are others.

    All texts stand behind each other. Between two neighbouring ends of tokens of either side there is one token of
    each, and those are linked; a group ends where both end.
    """
    good = [
        b"".join(map(a.pieces.__getitem__, x)) == w == b"".join(map(b.pieces.__getitem__, y)) and bool(w)
        for x, y, w in zip(a_ids, b_ids, wholes)
    ]
    chosen = [k for k, fine in enumerate(good) if fine]
    out: list[Aligned | None] = [None] * len(wholes)
    if chosen:
        flat = [np.fromiter(chain.from_iterable(x[k] for k in chosen), np.int64) for x in (a_ids, b_ids)]
        for k, found in zip(chosen, _between(a, b, *flat, [len(wholes[k]) for k in chosen])):
            out[k] = found
    return out


def _between(a: Tokens, b: Tokens, a_ids: np.ndarray, b_ids: np.ndarray, lengths: list[int]) -> list[Aligned] | None:
    """Tokens of texts of those bytes behind each other; None if a text ends inside a token."""
    flat = (a_ids, b_ids)
    ends = [np.cumsum(t.sizes[x]) for t, x in zip((a, b), flat)]
    every, common = np.union1d(*ends), np.intersect1d(*ends, assume_unique=True)
    stops = np.cumsum(lengths)
    if (common[np.minimum(np.searchsorted(common, stops), len(common) - 1)] != stops).any():
        return None
    pairs = flat[0][np.searchsorted(ends[0], every)] << SECOND_BITS | flat[1][np.searchsorted(ends[1], every)]
    pairs = pairs.astype(np.int64).tobytes()
    texts, places = [], []
    for k, (t, x, end) in enumerate(zip((a, b), flat, ends)):
        group = np.searchsorted(common, end)
        closes = common[group] == end
        texts.append(np.where(closes, t.decimals[b";" if k else b"|"][x], t.decimals[b","][x]))
        places.append(2 * group + k)
    order = np.argsort(np.concatenate(places), kind="stable")
    texts = np.concatenate(texts)[order].tolist()
    n_a, n_b, n_links, n_groups = (np.searchsorted(x, stops, "right").tolist() for x in (*ends, every, common))
    out, was = [], (0, 0, 0, 0)
    for now in zip(n_a, n_b, n_groups, n_links):
        text = b"".join(texts[was[0] + was[1] : now[0] + now[1]])[:-1]
        out.append(Aligned(*[y - x for x, y in zip(was, now)], text, pairs[8 * was[3] : 8 * now[3]]))
        was = now
    return out


class Aligner:
    """Aligns blocks of a text piece by piece, with a bounded memo of pieces: frequent ones come early and stay.

    ``path_a``: byte-level vocabulary, ``path_b``: sentencepiece vocabulary whose pieces hold a space only
    at their beginning (or nothing but spaces), no line feed, and no mark behind a letter; where one does, texts
    are not cut at such places.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a), pieces_level(path_b)
        self.cut_lines = not any(b"\n" in x and len(x) > 1 for x in self.b.pieces)
        self.cut_blanks = not any(b" " in x[1:] and x.strip(b" ") for x in self.b.pieces)
        self.memo, self.fixed = Memo(entries=REMEMBERED), {}
        texts = [x.decode(errors="ignore") for x in self.b.pieces]
        for mark in MARKS:
            # As behind a letter: a byte of the second vocabulary may look alike.
            ids = [t.encode(["a" + mark])[0][-1:] for t in (self.a, self.b)]
            joined = any(mark in x[1:] and any(y.isalpha() for y in x[: x.rindex(mark)]) for x in texts)
            (found,) = align(self.a, self.b, [ids[0]], [ids[1]], [mark.encode()])
            if found and not joined:
                self.fixed[mark] = found
        self.marks = frozenset(self.fixed)
        self.begin()

    def begin(self) -> None:
        """Called by a task: other operators' memos go, and what they may have emptied is put back."""
        own_memos("alignment")
        self.memo.update(self.fixed)

    def block(self, text: str) -> Aligned | None:
        """Space + ``text`` as one."""
        return align(self.a, self.b, self.a.encode([text]), self.b.encode([text]), [(" " + text).encode()])[0]

    def _made(self, keys: list[str]) -> list[Aligned | None]:
        """Pieces behind their space or line feed, encoded as one text: neither tokenizer joins them."""
        order = sorted(range(len(keys)), key=lambda k: keys[k][0] != " ")
        text = "".join([keys[k] for k in order])
        lead = text[0] != " "
        flat = []
        for tokens in (self.a, self.b):
            (ids,) = tokens.encode([text if lead else text[1:]])
            # Both read a space first; before a line feed it is a token of its own.
            if lead and ids and tokens.pieces[ids[0]] == b" ":
                ids = ids[1:]
            flat.append(ids)
        whole = text.encode()
        if all(b"".join(map(t.pieces.__getitem__, x)) == whole for t, x in zip((self.a, self.b), flat)):
            lengths = [len(keys[k].encode()) for k in order]
            found = _between(self.a, self.b, *[np.array(x, np.int64) for x in flat], lengths)
            if found is not None:
                out: list[Aligned | None] = [None] * len(keys)
                for k, x in zip(order, found):
                    out[k] = x
                return out
        return self._made_each(keys)

    def _made_each(self, keys: list[str]) -> list[Aligned | None]:
        """Where the bytes of some piece differ: each piece by itself."""
        texts = [k[1:] if k[0] == " " else k for k in keys]
        a, b = self.a.encode(texts), self.b.encode(texts)
        for k, key in enumerate(keys):
            if key[0] != " ":
                # Both read a space first, as a token of its own; without it nothing is cut.
                for ids, tokens in ((a, self.a), (b, self.b)):
                    ids[k] = ids[k][1:] if ids[k] and tokens.pieces[ids[k][0]] == b" " else []
        return align(self.a, self.b, a, b, [k.encode() for k in keys])

    def pieces(self, keys: list[str]) -> list[Aligned | None]:
        memo = self.memo
        missing = [k for k in dict.fromkeys(keys) if k not in memo]
        if not missing:
            return list(map(memo.__getitem__, keys))
        made = dict(zip(missing, self._made(missing)))
        out = [made[k] if k in made else memo[k] for k in keys]
        if len(memo) < REMEMBERED:
            memo.update((k, x) for k, x in made.items() if len(k) <= LONGEST)
        return out

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that follow a blank each (the first one the added space)."""
        begin = 0
        while self.cut_blanks and len(text) - begin > CUT:
            at = text.find(" ", begin + CUT)
            while at >= 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[begin:at]
            begin = at + 1
        yield text[begin:]

    def parts(self, text: str) -> Iterator[list[Aligned | None]]:
        """The alignments of the text's pieces in order, block by block."""
        marks = self.marks
        for block in self.blocks(text):
            around = f" {block} "
            odd = "  " in around or ODD_SPACE.search(block) or not self.cut_blanks
            if not odd and "\n" in block:
                odd = not self.cut_lines or "\n\n" in block or " \n" in around or "\n " in around
            if odd:
                yield [self.block(block)]
                continue
            keys = []
            for piece in block.replace("\n", " \n").split(" "):
                if piece[0] != "\n":
                    piece = " " + piece
                # A mark behind Latin letters is a token of its own in both.
                if piece[-1] in marks and (letters := piece[1:-1]).isalpha() and max(letters) <= LATIN_END:
                    keys += piece[:-1], piece[-1]
                else:
                    keys.append(piece)
            yield self.pieces(keys)


# -- runs ------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, bytes of equal weight side by side, as one zstd frame."""
    head = np.array([len(x) for x in arrays], "<u4").tobytes()
    body = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zstandard.compress(head + b"".join(body), 3)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    out, at = [], 4 * n
    for size in np.frombuffer(raw, "<u4", n):
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * int(size)
    return out


def _pack_pairs(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending pairs with counts below 2**63, in blocks: (length, frame) after each other."""
    out = []
    for k in range(0, len(pairs), BLOCK):
        p, c = pairs[k : k + BLOCK], counts[k : k + BLOCK]
        first, second = p >> SECOND_BITS, p & ((1 << SECOND_BITS) - 1)
        frame = _pack(np.diff(first, prepend=0), second, c & 0xFFFFFFFF, c >> 32)
        out += [np.array([len(frame)], "<u4").tobytes(), frame]
    return b"".join(out)


def _pair_blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(data):
        (size,) = np.frombuffer(data, "<u4", 1, at)
        first, second, low, high = _unpack(data[at + 4 : at + 4 + int(size)], 4)
        at += 4 + int(size)
        yield np.cumsum(first, dtype=np.int64) << SECOND_BITS | second, high.astype(np.int64) << 32 | low


def _entries(data: bytes) -> Iterator[tuple[int, int]]:
    for pairs, counts in _pair_blocks(data):
        yield from zip(pairs.tolist(), counts.tolist())


def _merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of runs: a heap of their heads gives the pairs in order."""
    pairs: list[int] = []
    counts: list[int] = []
    for pair, n in heapq.merge(*map(_entries, runs)):
        if pairs and pairs[-1] == pair:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
    return np.array(pairs, np.int64), np.array(counts, np.int64)


SCHEMA = pa.schema([
    ("run", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("part", pa.int32()), ("pairs", pa.binary()), ("records", pa.binary()),
])
DDL = (
    "run long, slot int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "part int, pairs binary, records binary"
)


class _Run:
    """Documents of a run: their rows and their pair-document records."""

    def __init__(self, number: int):
        self.number, self.docs = number, []
        self.keys, self.times, self.size = [], [], 0

    def add(self, row: tuple, pairs: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(pairs << 12 | len(self.docs))
        self.times.append(times)
        self.size += len(pairs)
        self.docs.append(row)

    def batches(self) -> Iterator[pa.RecordBatch]:
        names = SCHEMA.names
        n = len(self.docs)
        rows = dict(zip(names[2:8], zip(*self.docs)))
        yield self._batch(rows | {"run": [self.number] * n, "slot": range(n)}, n)
        keys = np.concatenate(self.keys)
        part = keys >> (12 + SECOND_BITS) & (PARTS - 1)
        # Side-major inside a part: by first id, second id, document.
        order = np.lexsort((keys, part))
        keys, part, times = keys[order], part[order], np.concatenate(self.times)[order]
        for k in np.unique(part):
            lo, hi = np.searchsorted(part, [k, k + 1])
            some, many = keys[lo:hi], times[lo:hi]
            pairs, at = np.unique(some >> 12, return_index=True)
            slots = some & 4095
            # Inside a pair slots ascend: their steps are small.
            steps = np.diff(slots, prepend=0)
            steps[at] = slots[at]
            n_docs = np.diff(np.append(at, len(some)))
            yield self._batch({
                "run": [self.number], "part": [int(k)],
                "pairs": [_pack_pairs(pairs, n_docs)], "records": [_pack(n_docs, steps, many)],
            }, 1)

    @staticmethod
    def _batch(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(columns.get(f.name, [None] * n)), f.type) for f in SCHEMA], schema=SCHEMA
        )


def _document(aligner: Aligner, text: str | None):
    """(n_a, n_b, n_groups, n_links, digest), distinct pairs, times of each."""
    none = (0, 0, 0, 0, ""), np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    digest, n_a, n_b, n_groups, n_links = hashlib.sha256(), 0, 0, 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for parts in aligner.parts(text):
        if None in parts:
            return none
        a, b, new_groups, new_links, texts, pairs = zip(*parts)
        digest.update((b";" if n_groups else b"") + b";".join(texts))
        n_a, n_b, n_groups, n_links = n_a + sum(a), n_b + sum(b), n_groups + sum(new_groups), n_links + sum(new_links)
        links = np.frombuffer(b"".join(pairs), np.int64)
        held.append(_counted(links, np.ones(len(links), np.int64)))
        if len(held) > 8:
            held = [_counted(*map(np.concatenate, zip(*held)))]
    pairs, times = held[0] if len(held) == 1 else _counted(*map(np.concatenate, zip(*held)))
    return (n_a, n_b, n_groups, n_links, digest.hexdigest()), pairs, times


def _counted(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, with the sums of their times."""
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[at], np.add.reduceat(times, at) if len(times) else times


@cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each worker, so that its memo outlives a task."""
    return Aligner(path_a, path_b)


def runs(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id") -> DataFrame:
    """Rows of documents (``part`` is null) and zstd runs of their pair-document records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        aligner.begin()
        number = TaskContext.get().partitionId() << 32
        current = _Run(number)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row, pairs, times = _document(aligner, text.as_py())
                current.add((key, *row), pairs, times)
                if len(current.docs) == RUN_DOCS or current.size >= RUN_RECORDS:
                    yield from current.batches()
                    number += 1
                    current = _Run(number)
        if current.docs:
            yield from current.batches()

    return docs.select(F.col(id_column).cast("long").alias("id"), "text").mapInArrow(run, DDL)


def merged(pairs: DataFrame) -> DataFrame:
    """(part, pairs): one run of counted pairs for each part, from (part, run, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            found, counts = _merge(held)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([key[0]], pa.int32()), "run": pa.array([key[1]], pa.int64()),
                "pairs": pa.array([_pack_pairs(found, counts)], pa.binary()),
            })

        key, held = None, []
        for batch in batches:
            for part, group, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and (part, group) != key:
                    yield flush()
                    held = []
                key = (part, group)
                held.append(data)
        if held:
            yield flush()

    n_runs = pairs.select("run").distinct().count()
    while True:
        # Some FAN_IN runs meet, dealt by a hash.
        n_runs = max(-(-n_runs // FAN_IN), 1)
        grouped = pairs.select("part", F.pmod(F.xxhash64("run"), F.lit(n_runs)).alias("run"), "pairs")
        dealt = grouped.repartition("part", "run").sortWithinPartitions("part", "run")
        pairs = written(dealt.mapInArrow(run, "part int, run long, pairs binary"), "alignment-merged")
        if n_runs == 1:
            return pairs.select("part", "pairs")


def counts(merged_pairs: DataFrame) -> DataFrame:
    """(a, b, n_docs, best) of all pairs: the corpus-wide table, for other uses than ``align_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                pairs, n, best = _with_best(data)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(pairs >> SECOND_BITS, pa.int64()), "b": pa.array(pairs & ((1 << SECOND_BITS) - 1), pa.int64()),
                    "n_docs": pa.array(n, pa.int64()), "best": pa.array(best, pa.bool_()),
                })

    return merged_pairs.mapInArrow(run, "a long, b long, n_docs long, best boolean")


def _with_best(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a part in side-major order, their counts, and whether their first id has none higher."""
    blocks = list(_pair_blocks(data))
    pairs, n = (np.concatenate([x[k] for x in blocks]) for k in (0, 1))
    first = pairs >> SECOND_BITS
    at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    highest = np.maximum.reduceat(n, at)
    return pairs, n, n == np.repeat(highest, np.diff(np.append(at, len(n))))


def _contributions(found: DataFrame, merged_pairs: DataFrame) -> DataFrame:
    """(run, n_docs, n_best, count_sum): for each part of a run arrays over its documents, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table = None, None
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(4))
            for at, number, pairs, records in zip(*columns):
                if number < 0:
                    part, table = at, _with_best(pairs)
                    continue
                assert part == at
                own = np.concatenate([x[0] for x in _pair_blocks(pairs)])
                n_docs, slots, times = (x.astype(np.int64) for x in _unpack(records, 3))
                where = np.searchsorted(table[0], own)
                begin = np.cumsum(n_docs) - n_docs
                # Slots were stored as steps from the pair's first one.
                total = np.cumsum(slots)
                slots = total - np.repeat(total[begin] - slots[begin], n_docs)
                n, best = np.repeat(table[1][where], n_docs), np.repeat(table[2][where], n_docs)
                size = int(slots.max()) + 1
                n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(n_best, slots, times * best)
                np.add.at(count_sum, slots, times * n)
                packed = zstandard.compress(np.concatenate([n_best, count_sum]).tobytes(), 3)
                yield pa.RecordBatch.from_pydict({"run": pa.array([number], pa.int64()), "sums": pa.array([packed], pa.binary())})

    numbers = found.select("run").distinct()
    slices = max(-(-numbers.count() // SLICE), 1)
    slice_of = F.pmod(F.xxhash64("run"), F.lit(slices))
    records = found.select(slice_of.alias("slice"), "part", "run", "pairs", "records")
    # A part's counts go to each of its slices, before the runs.
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")
    tables = merged_pairs.select(spread, "part", F.lit(-1).cast("long").alias("run"), "pairs", F.lit(None).cast("binary").alias("records"))
    dealt = records.unionByName(tables).repartition("slice", "part").sortWithinPartitions("slice", "part", "run")
    return dealt.drop("slice").mapInArrow(run, "run long, sums binary")


def _summed(contributions: DataFrame) -> DataFrame:
    """(run, slot, n_best, count_sum): the contributions of all parts of a run, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            used = np.flatnonzero(total[0])
            return pa.RecordBatch.from_pydict({
                "run": pa.array(np.full(len(used), key), pa.int64()), "slot": pa.array(used, pa.int32()),
                "n_best": pa.array(total[1][used], pa.int64()), "count_sum": pa.array(total[2][used], pa.int64()),
            })

        key, total = None, None
        for batch in batches:
            for number, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != key:
                    if key is not None:
                        yield flush()
                    key, total = number, np.zeros((3, RUN_DOCS), np.int64)
                added = np.frombuffer(zstandard.decompress(sums), np.int64).reshape(2, -1)
                n = added.shape[1]
                total[0, :n] += added[1] > 0
                total[1:, :n] += added
        if key is not None:
            yield flush()

    dealt = contributions.repartition("run").sortWithinPartitions("run")
    return dealt.mapInArrow(run, "run long, slot int, n_best long, count_sum long")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id") -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    everything = written(runs(docs, path_a, path_b, id_column), "alignment-runs")
    rows = everything.where("part IS NULL").select("run", "slot", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = everything.where("part IS NOT NULL")
    table = merged(found.select("part", "run", "pairs"))
    sums = _summed(_contributions(found, table))
    joined = rows.join(sums, ["run", "slot"], "left").drop("run", "slot")
    return joined.na.fill(0, ["n_best", "count_sum"]).select(
        "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
