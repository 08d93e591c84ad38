"""Operator 1, token ids in binary files of directly addressable codes.

An id is split into chunks of ``chunk_bits`` bits. Level 0 holds the low chunk of every token; a
bitmap says which tokens go on; level 1 holds the next chunk of those, and so on. A rank directory
counts the ones of a bitmap before every block of 512 bits, so the place of a token's next chunk is
one directory entry and the bits of one block: any token is read without decoding those before it.

A file (all little-endian): the magic, then 8 unsigned 64-bit integers (part, number within the part,
documents, tokens, chunk bits, levels, two of reserve), the documents' ids (64 bits) and a byte for each that is
0 where the id is null, the starts of the documents within the file and their end, then for each
level its length, its chunks (8, 16 or 32 bits), its bitmap in 64-bit words and its directory. Files are
written by Spark's own writer, one row and one file for each segment, so its commit protocol covers
lost tasks; the writer's row separator, one line feed, ends the file.

Documents go to parts by ranges of their ids and are sorted within, so parts, files and tokens are in
ascending order of ids. Defined results: null text counts as empty; a null id comes first; rows that
repeat an id are neighbours, ordered by text; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectorpulse.llm.common import own_memos, text_or_empty, written
from sectorpulse.llm.encoding import byte_level

MAGIC = b"DACTOK01"
BLOCK = 512
#: Tokens from which a file is closed: about 1 MB with 8-bit chunks.
SEGMENT_TOKENS = 1 << 19

_KINDS = {8: np.dtype("<u1"), 16: np.dtype("<u2"), 32: np.dtype("<u4")}
_U64 = np.dtype("<u8")


def _levels(values: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    while True:
        rest = values >> np.uint32(bits) if bits < 32 else np.zeros_like(values)
        more = rest != 0
        packed = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(values) // 64), _U64)
        words.view(np.uint8)[: len(packed)] = packed
        per_word = np.bitwise_count(words).astype(_U64)
        blocks = np.add.reduceat(per_word, np.arange(0, len(words), BLOCK // 64)) if len(words) else per_word
        directory = np.zeros(len(blocks) + 1, _U64)
        np.cumsum(blocks, out=directory[1:])
        yield values.astype(_KINDS[bits]), words, directory  # the cast keeps the low bits
        if not more.any():
            return
        values = rest[more]


def encode_file(part: int, number: int, ids: list[int | None], tokens: list[bytes], bits: int = 8) -> bytes:
    """A file of documents; ``tokens`` are little-endian unsigned 32-bit integers."""
    starts = np.zeros(len(ids) + 1, _U64)
    np.cumsum([len(x) // 4 for x in tokens], out=starts[1:])
    levels = list(_levels(np.frombuffer(b"".join(tokens), "<u4"), bits))
    out = [
        MAGIC,
        struct.pack("<8Q", part, number, len(ids), int(starts[-1]), bits, len(levels), 0, 0),
        np.array([i or 0 for i in ids], "<i8").tobytes(),
        bytes(i is not None for i in ids),
        starts.tobytes(),
    ]
    for chunks, words, directory in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), words.tobytes(), directory.tobytes()]
    return b"".join(out)


class TokenFile:
    """Random access to the tokens of one file; the bytes may be a memory map."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.part, self.number, n, self.n_tokens, bits, levels, _, _ = struct.unpack_from("<8Q", data, 8)
        at = 72
        ids, known = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "u1", n, at + 8 * n)
        self.ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.frombuffer(data, _U64, n + 1, at + 9 * n)
        at += 9 * n + 8 * (n + 1)
        self.bits, self.levels = bits, []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            n_words = -(-size // 64)
            for kind, count in ((_KINDS[bits], size), (_U64, n_words), (_U64, -(-n_words // (BLOCK // 64)) + 1)):
                parts.append(np.frombuffer(data, kind, count, at))
                at += count * kind.itemsize
            self.levels.append(parts)

    def token(self, i: int) -> int:
        """Token ``i``; reads one chunk a level and at most one block of each bitmap."""
        value = shift = 0
        for chunks, words, directory in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            if not (int(words[word]) >> bit) & 1:
                break
            block = i // BLOCK
            before = words[block * (BLOCK // 64) : word]
            inside = int(words[word]) & ((1 << bit) - 1)
            i = int(directory[block]) + int(np.bitwise_count(before).sum()) + inside.bit_count()
            shift += self.bits
        return value

    def tokens(self) -> np.ndarray:
        """All tokens, level by level."""
        values = np.zeros(self.n_tokens, "<u4")
        places = np.arange(self.n_tokens)
        for level, (chunks, words, _) in enumerate(self.levels):
            values[places] |= chunks.astype("<u4") << np.uint32(level * self.bits)
            more = np.unpackbits(words.view(np.uint8), bitorder="little", count=len(chunks)).astype(bool)
            places = places[more]
        return values


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    bits: int = 8,
    segment_tokens: int = SEGMENT_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every document and write the files of ``folder``, in ascending order of ids."""
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        own_memos("bytes")
        code, part = byte_level(tokenizer), TaskContext.get().partitionId()
        number, held, ids, tokens = 0, 0, [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                tokens.append(code(text.as_py()) + end)
                held += len(tokens[-1]) // 4
                if held >= segment_tokens:
                    yield _file(encode_file(part, number, ids, tokens, bits))
                    number, held, ids, tokens = number + 1, 0, [], []
        if ids:
            yield _file(encode_file(part, number, ids, tokens, bits))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    files = dealt.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(encode, "content binary")
    # A cast of binary to string keeps the bytes; the text writer writes them as they are.
    files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _file(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])


READ = "part long, number long, place long, id long, first long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files; start counts the tokens before it."""

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                if not len(content.as_buffer()):  # Spark's writer leaves an empty file for an empty table
                    continue
                file = TokenFile(content.as_buffer())
                data, starts = file.tokens().tobytes(), file.starts.tolist()
                n = len(file.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.part] * n, pa.int64()),
                        pa.array([file.number] * n, pa.int64()),
                        pa.array(range(n), pa.int64()),
                        pa.array(file.ids, pa.int64()),
                        pa.array(starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(
                            [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)],
                            pa.int64(),
                        ),
                    ],
                    [x.split()[0] for x in READ.split(", ")],
                )

    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = written(files.mapInArrow(decode, READ), "token-documents")
    # Token counts by file, then by part: as many rows as files, and as parts.
    by_file = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    until = (Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy("number").rowsBetween(*until)
    of_parts = Window.orderBy("part").rowsBetween(*until)
    parts = by_file.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(of_parts), F.lit(0)).alias("part_first"))
    base = by_file.select("part", "number", F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("file_first"))
    base = base.join(parts, "part").select("part", "number", (F.col("part_first") + F.col("file_first")).alias("base"))
    placed = rows.join(base, ["part", "number"])
    return placed.select("id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
