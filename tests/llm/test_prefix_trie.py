import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorpulse.llm import prefix_trie, queries, scans

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    """Conversation -> its turns in the defined order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(turns)] for c, turns in out.items()}


def rebuild(conversations):
    out = {}
    for c, turns in conversations.items():
        h = crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(paths):
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    rows = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        ends = sorted(c for c in members if len(paths[c]) == len(path))
        rows.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])),
            sum(q not in children for q in below),
            sum((len(nodes[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS `group`", "2 AS words", "3 AS depth")
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_prefix_trie(spark, str(tmp_path))
    return sorted((tuple(r) for r in found.collect()), key=str)


def random_rows(seed, n, texts=3, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", None, ""])
            rows.append((c, t if rng.random() > 0.1 else None, role, rng.choice([None, "", "a b", "a\tb c", "x" * 50][:texts])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, tmp_path, seed):
    rows = random_rows(seed, 60, texts=5)
    assert run(spark, tmp_path, rows) == brute(rebuild(ordered(rows)))


def test_crowded_sketch(spark, tmp_path, monkeypatch):
    """With eight cells nearly every prefix counts as perhaps shared: the result is the same."""
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", 8)
    monkeypatch.setattr(prefix_trie, "SKETCH_CELLS", 64)
    rows = random_rows(7, 50)
    assert run(spark, tmp_path, rows) == brute(rebuild(ordered(rows)))


def test_copies_ties_nulls_and_missing_bases(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}") for c in range(40, 70) for t in range(8)]
    rows += [(5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "assistant", "same"), (5, None, None, None)]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (999, 0, "a", "only")]
    # Fewer turns than the head: conversations without a base may end up without turns.
    rows += [(c, 0, "user", "one") for c in range(1001, 1020)]
    rows += [(2000, 0, "user", "long " * 200_000)]
    assert run(spark, tmp_path, rows) == brute(rebuild(ordered(rows)))


def test_a_third_of_all_rows_in_one_conversation(spark, tmp_path):
    rows = [(20, t, "user", f"t{t}") for t in range(300)] + [(21, t, "user", f"t{t}") for t in range(280)]
    rows += [(c, 0, "user", f"t{c}") for c in range(100, 160)]
    assert run(spark, tmp_path, rows) == brute(rebuild(ordered(rows)))


def test_no_conversations(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_scan_over_tasks(spark):
    rows = [(g, o, hashlib.sha256(f"{g} {o}".encode()).digest(), o) for g in range(3) for o in range(200)]
    df = spark.createDataFrame(rows, "`group` long, o long, d binary, v long").repartition(5)
    got = {(r["group"], r["o"]): r for r in scans.scan(df, ["o"], digest="d", value="v").collect()}
    for g in range(3):
        key, total = scans.SEED, 0
        for o in range(200):
            row = got[g, o]
            assert (row["index"], row["before"], row["last"]) == (o, total, o == 199)
            assert bytes(row["parent"]) == key.to_bytes(16, "big")
            key, total = scans.folded(key, rows[g * 200 + o][2]), total + o
            assert bytes(row["key"]) == key.to_bytes(16, "big")


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    keys = [rng.bytes(16) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys + keys[:100]], "key binary").repartition(4)
    import pyarrow as pa

    for width in (64, 1 << 16):
        single = prefix_trie._single(prefix_trie.sketch(df, width), pa.array(keys, pa.binary()))
        assert not single[:100].any()
    assert single[100:].mean() > 0.95


def test_nodes_with_their_last_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "user", "c"), (2, 0, "user", "a b")], SCHEMA)
    turns = prefix_trie.turn_rows(df)
    nodes = prefix_trie.with_turns(prefix_trie.build(turns).nodes, turns)
    assert sorted((r["depth"], r["words"]) for r in nodes.where(F.col("depth") > 0).collect()) == [(1, 2), (2, 1)]
