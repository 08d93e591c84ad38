"""Operators 1, 4 and 5 against the library, exact round trips and a packer that looks at every piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sectorpulse.llm import common, encoding, packing, token_counts, token_store

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PARTS = ["a", "B", "Σ", "ΑΣ", "é", "é", " ", "  ", "\n", "\n\n", "\t", "　", "\xa0", "\x1c", "\x85", "\x00"]
PARTS += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "1", "23", "!!", "…", "日本", "🙂", "İ", "ß"]
PARTS += ["don't", "the", "the,", "\r\n", "aaaa", "aaaaa", "​", "ﬁ", "end.", "U.S.", "\U00019181", "Ƛ"]


def texts(n=4000, seed=1):
    r = random.Random(seed)
    found = ["", "x" * 5000, "word, " * 800]
    found += ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]
    return found + ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF)])) for _ in range(9)) for _ in range(n)]


@pytest.mark.parametrize("path, encoder", [(BYTES, encoding.byte_level), (WORDS, encoding.word_level)])
def test_ids_are_those_of_the_library(path, encoder):
    library, encode = Tokenizer.from_file(path), encoder(path)
    for text in texts():
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_counts_are_those_of_the_library():
    found = texts(seed=2)
    wanted = [len(e.ids) for e in Tokenizer.from_file(WORDS).encode_batch(found, add_special_tokens=False)]
    assert token_counts.counter(WORDS)(found) == wanted


def test_counts_without_room_in_the_memo(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 3)
    counter = token_counts.Counter(WORDS)
    for _ in range(2):
        assert counter(["one two three four", "two five", ""]) == [4, 2, 0]


def test_count_rows(spark, frame):
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x " * 3000)]
    found = token_counts.count(frame(rows), WORDS, limit=2).collect()
    assert sorted(map(str, found)) == sorted(
        str(r) for r in [token_row(1, 3, 2), token_row(2, 0, 0), token_row(3, 0, 0), token_row(1, 3, 2), token_row(None, 6000, 3000)]
    )
    assert token_counts.count(frame([]), WORDS).collect() == []


def token_row(doc, n_bytes, n_tokens):
    from pyspark.sql import Row

    return Row(id=doc, n_bytes=n_bytes, n_tokens=n_tokens, over_limit=n_tokens > 2)


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_every_token_of_a_file_by_itself(bits):
    r = random.Random(bits)
    docs = [np.array([r.choice([0, 1, 255, 256, 70000, 2**32 - 1]) for _ in range(r.randint(0, 900))], "<u4") for _ in range(9)]
    file = token_store.TokenFile(token_store.encode_file(3, 4, [5, None, *range(7)], [d.tobytes() for d in docs], bits))
    wanted = np.concatenate(docs)
    assert (file.part, file.number, file.ids) == (3, 4, [5, None, *range(7)])
    assert file.starts.tolist() == np.cumsum([0, *map(len, docs)]).tolist()
    assert (file.tokens() == wanted).all()
    assert [file.token(i) for i in range(len(wanted))] == wanted.tolist()


def test_token_files_round_trip(spark, frame, tmp_path):
    rows = [(4, "d e"), (2, None), (9, ""), (2, "b c"), (None, "n"), (7, "long text " * 500)]
    folder = str(tmp_path / "tokens")
    token_store.write(frame(rows), folder, BYTES, end_id=2, segment_tokens=50)
    encode = encoding.byte_level(BYTES)
    wanted, start = [], 0
    for doc, text in [(None, "n"), (2, ""), (2, "b c"), (4, "d e"), (7, "long text " * 500), (9, "")]:
        ids = encode(text) + (2).to_bytes(4, "little")
        wanted.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, token_store.read(spark, folder).collect()), key=lambda r: r[1]) == wanted
    empty = str(tmp_path / "none")
    token_store.write(frame([]), empty, BYTES, end_id=2)
    assert token_store.read(spark, empty).collect() == []


def test_plan_is_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.choice([1, 5, 16, 37])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(capacity - n)
        placed = {}
        for n, runs in packing.plan(histogram, capacity).items():
            for rank in range(histogram[n]):
                first, sequence, each, offset = [x for x in runs if x[0] <= rank][-1]
                place = (offset + (rank - first) % each * n, n)
                placed.setdefault(sequence + (rank - first) // each, []).append(place)
        assert sorted(capacity - sum(n for _, n in p) for p in placed.values()) == sorted(rooms)
        for places in placed.values():
            assert [at for at, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]


def test_pack_rows(spark, frame):
    rows = [(k % 40, "ab " * (k * 7 % 50)) for k in range(300)] + [(500, None), (None, "x"), (501, "cd " * 500)]
    encode = encoding.word_level(WORDS)
    found = packing.pack(frame(rows), WORDS, capacity=64).collect()
    pieces = sorted((r.length, r.ids_crc32) for r in found)
    wanted, total = [], 0
    for _, text in rows:
        ids = encode(text or "") + bytes(4)
        total += len(ids) // 4
        wanted += [(len(ids[a : a + 256]) // 4, zlib.crc32(ids[a : a + 256])) for a in range(0, len(ids), 256)]
    assert pieces == sorted(wanted)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 64
    assert len(sequences) <= 1.02 * total / 64 + 1
    assert packing.pack(frame([]), WORDS).collect() == []


def test_a_worker_forgets_other_operators():
    from sectorpulse.llm import common

    common.own_memos("first")
    memo = common.Memo(len, 2)
    assert [memo[x] for x in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1] and len(memo) == 2
    common.own_memos("first")
    assert len(memo) == 2
    common.own_memos("second")
    assert not memo and memo["dddd"] == 4


def test_texts_reach_the_packer_in_bounded_batches(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    width, rows = 20_000, 2_000
    docs = spark.range(rows, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), width // 3).alias("text"))
    made = packing._batch

    def counted(found, schema):
        # One batch of pieces for each batch of texts.
        sizes.add(1)
        return made(found, schema)

    monkeypatch.setattr(packing, "_batch", counted)
    packed = packing.pack(docs, WORDS)
    assert packed.select("id").distinct().count() == rows
    assert sizes.value >= width * rows // (2 * common.BATCH_BYTES)


def test_a_session_keeps_its_own_batch_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1m")
        common.bound_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
