"""Operator 8 against brute force: every window of 50 words of every document is looked up in all others."""

import random

from sectorpulse.llm import substring_dedup as dedup

R = random.Random(21)


def words(n, longest=9):
    return ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, longest))) for _ in range(n)]


def brute(docs, n=50):
    """{(id, later): word positions} that another document has in a passage of ``n`` words."""
    holders, found = {}, {}
    for doc, text in docs:
        split = text.split(" ")
        for k in range(len(split) - n + 1):
            holders.setdefault(tuple(split[k : k + n]), []).append((doc, k))
    for places in holders.values():
        ids = {doc for doc, _ in places}
        for doc, k in places:
            for later, there in ((True, min(ids) < doc), (False, max(ids) > doc)):
                if there:
                    found.setdefault((doc, later), set()).update(range(k, k + n))
    return found


def reported(frame, docs):
    texts, found = dict(docs), {}
    for r in dedup.passages(frame(docs)).collect():
        text = texts[r.id].encode()
        first = text[: r.start].decode().count(" ")
        assert len(text[r.start : r.end].decode().split(" ")) == r.n_words >= 50
        found.setdefault((r.id, r.later), set()).update(range(first, first + r.n_words))
    return found


def test_stock_sentences_that_stand_elsewhere_first(frame):
    docs, stock = [], [words(R.randint(6, 20)) for _ in range(12)]
    for sentence in stock:
        docs.append(words(40) + sentence + words(40))
    for _ in range(15):
        passage = [w for s in R.sample(stock, 3) for w in s + words(R.randint(1, 6))]
        passage += words(max(0, R.randint(50, 80) - len(passage)))
        # One document quotes only the middle, before the two that have all of it.
        docs.append(words(30) + passage[8:-8] + words(30))
        docs += [words(R.randint(0, 60)) + passage + words(R.randint(0, 60)) for _ in range(2)]
    docs = [(k, " ".join(d)) for k, d in enumerate(docs)]
    expected = brute(docs)
    assert len(expected) >= 30 and reported(frame, docs) == expected


def test_passages_of_just_fifty_words(frame):
    docs = []
    for longest in (1, 2, 4, 9, 40):
        for n in (49, 50, 51, 60):
            for _ in range(6):
                passage = words(n, longest)
                docs += [words(R.randint(0, 30)) + passage + words(R.randint(0, 30)) for _ in range(2)]
    docs = [(k, " ".join(d)) for k, d in enumerate(docs)]
    expected = brute(docs)
    assert len(expected) >= 180 and reported(frame, docs) == expected


def test_chain_of_overlapping_quotes_keeps_every_part_once(frame):
    p, q, r = (" ".join(words(n)) for n in (60, 70, 80))
    docs = [(1, f"{p} {q}"), (2, f"{p} {q} {r}"), (3, f"{q} {r}")]
    assert reported(frame, docs) == brute(docs)
    after = {x.doc_id: x.text.strip() for x in dedup.cut(frame(docs)).collect()}
    assert after == {1: f"{p} {q}", 2: r, 3: ""}
