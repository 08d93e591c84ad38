"""Operator 8 on planted passages, and its hash and chunks by a plain loop."""

import random

import numpy as np

from sectorpulse.llm import substring_dedup as dedup

R = random.Random(9)


def prose(n):
    return " ".join("".join(R.choice("abcdeéfgh") for _ in range(R.randint(1, 9))) for _ in range(n))


def test_gear_hash_and_chunks_by_a_loop():
    for _ in range(60):
        data = prose(R.randint(0, 120)).encode()[R.randint(0, 3) :]
        h, hashes = 0, []
        for b in data:
            h = (2 * h + int(dedup.GEAR[b])) % 2**32
            hashes.append(h)
        assert not data or [int(x) & 0xFFFF for x in dedup.gear(np.frombuffer(data, np.uint8))] == [x & 0xFFFF for x in hashes]
        ends, start = [], 0
        for k in range(1, len(data) + 1):
            size = k - start
            if k == len(data) or size == dedup.MAX_CHUNK or (size >= dedup.MIN_CHUNK and not hashes[k - 1] & int(dedup.END_BITS)):
                ends.append(k)
                start = k
        assert dedup.cut_points(data) == ends


def test_planted_passages(frame):
    passages = [prose(R.randint(51, 70)) for _ in range(30)]
    line, docs, planted = prose(14), [], set()
    for passage in passages:
        for _ in range(R.randint(2, 3)):
            planted.add(len(docs))
            docs.append((len(docs), f"{prose(R.randint(0, 200))}\n{passage} {prose(R.randint(0, 200))}"))
    for _ in range(60):
        docs.append((len(docs), f"{prose(R.randint(0, 150))} {line} {prose(R.randint(0, 100))}"))
    for _ in range(20):
        short = prose(R.randint(20, 44))
        docs += [(len(docs), f"{prose(60)} {short} {prose(60)}"), (len(docs) + 1, f"{prose(60)} {short} {prose(60)}")]
    n, copy, small = len(docs), prose(60), prose(20)
    docs += [(n, None), (n + 1, ""), (n + 2, copy), (n + 3, small), (n + 4, copy), (n + 5, small), (None, copy), (n + 2, prose(9))]
    planted |= {n + 2, n + 4, None}
    texts = dict(docs[:-1])
    found = dedup.passages(frame(docs)).collect()
    assert {r.id for r in found} == planted
    for r in found:
        part = texts[r.id].encode()[r.start : r.end].decode()
        assert part in texts[r.other_id] and len(part.split()) == r.n_words >= 50
    kept = dedup.cut(frame(docs))
    assert kept.columns == frame(docs).columns
    after = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(after) == len(docs)
    for passage in passages:
        assert sum(passage in (text or "") for _, text in after) == 1
    assert [text for doc, text in after if doc == n] == [None]


def test_extension_checks_the_range():
    one, two = b"xx hello world yy", b"hello world zz"
    assert dedup.common_around(one, two, 5, 9, 3) == (3, 15)
    assert dedup.common_around(one, two, 5, 9, 2) is None
    assert dedup.whole_words(b"ab cd ef gh", 1, 10) == (3, 8, 2)
    assert dedup.whole_words(b"ab cd", 0, 5) == (0, 5, 2)
    assert dedup.whole_words(b"abcd", 1, 3)[2] == 0


def test_empty_table(frame):
    assert dedup.passages(frame([])).collect() == [] == dedup.cut(frame([])).collect()
