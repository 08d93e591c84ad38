"""Operator 10 against a dictionary of normalised texts."""

import hashlib
import random
import re

import pytest

from sectorpulse.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    found = []
    for plain, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(plain.encode()).hexdigest()
        found += [(doc, keep, len(members), doc == keep, digest) for doc, _ in members]
    return sorted(found, key=str)


def rows(seed, n=300):
    r = random.Random(seed)
    found = [(k, r.choice(["a b", "ab", "a\tb\x0b", "ab\xa0", "é", "é", "", None, " ", "hot  text", "hot text"])) for k in range(n)]
    found += [(n + k, f"text {k % 90}" + " " * (k % 3)) for k in range(n)]
    found += [(-(2**63), "low"), (2**63 - 1, "low"), (None, "low "), (None, "alone"), (7, "twice"), (7, "twice")]
    return found + [(n * 3, "x" * 100_000), (n * 3 + 1, " ".join("x" * 100_000))]


@pytest.mark.parametrize("support", [0.2, 0.001])
def test_marks_are_those_of_a_dictionary(frame, support):
    given = rows(1)
    assert sorted(map(tuple, exact_dedup.mark(frame(given), support=support).collect()), key=str) == brute(given)


def test_one_row_of_each_group_stays(frame):
    given = frame(rows(2))
    kept = exact_dedup.deduplicate(given, support=0.2)
    assert kept.columns == given.columns
    wanted = {(doc, digest) for doc, _, _, stays, digest in brute(rows(2)) if stays}
    found = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_empty_table(frame):
    assert exact_dedup.mark(frame([])).collect() == [] == exact_dedup.deduplicate(frame([])).collect()


def test_only_built_in_functions(frame, capsys):
    exact_dedup.mark(frame(rows(3, 20))).explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
