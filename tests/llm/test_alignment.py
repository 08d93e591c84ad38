import hashlib
from collections import Counter

from sectorpulse.llm import alignment
from sectorpulse.llm.common import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """Every pair of token occurrences compared by byte range, from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary(A))
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=vocabulary(B))
    symbols = alignment.byte_symbols()

    def spans(pieces):
        at, out = 0, []
        for piece in pieces:
            out.append((at, at + len(piece)))
            at += len(piece)
        return out

    linked, out = [], {}
    for number, (key, text) in enumerate(rows):
        zero = (0, 0, 0, 0, ""), []
        if not text:
            linked.append((key, *zero))
            continue
        whole = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        pa = [bytes(symbols[c] for c in first.id_to_token(i)) for i in a]
        pb = []
        for i in b:
            p = second.id_to_piece(i)
            pb.append(bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(pa) != whole or b"".join(pb) != whole:
            linked.append((key, *zero))
            continue
        sa, sb = spans(pa), spans(pb)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (f, g) in zip(b, sb) if s < g and f < e]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(
                ",".join(str(x) for x, (s, e) in zip(ids, sp) if start <= s and e <= end) for ids, sp in ((a, sa), (b, sb))
            ))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        linked.append((key, (len(a), len(b), len(groups), len(links), digest), links))
    count = Counter(pair for _, _, links in linked for pair in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for key, row, links in linked:
        n_best = sum(count[x] == best[x[0]] for x in links)
        out.setdefault(key, []).append((*row[:4], n_best, sum(count[x] for x in links), row[4]))
    return {k: sorted(v) for k, v in out.items()}


def found(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["id"], []).append(tuple(row)[1:])
    return {k: sorted(v) for k, v in out.items()}


ODD = [
    "plain words here, and there.", "two  spaces", " leads", "trails ", "trails\n", "\nleads", "a\nb\n\nc", "tab\tand\rreturn",
    "　wide space", "▁", "a▁b", "<|endoftext|> and <s> <unk> <0x0A>", "don't we'll I'm 'tis", "\x00null \x1cfour",
    "中文没有空格。很长", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 flags", "ﬁ ½ é ̈x", "", None, " ", "\n", "x", "word\n.\n,\nend",
    "1234567890 3.14 1,000", "plain words here, and there.", "!!! ??? ...", "A B   C", "a \nb", "a\n b",
]


def test_against_all_pairs(spark, frame):
    texts = ODD + [t + " again" if t else t for t in ODD] + [" ".join(filter(None, ODD))] * 2
    rows = list(enumerate(texts)) + [(3, "a repeated id"), (3, "a repeated id")]
    df = frame(rows).repartition(3)
    assert found(alignment.align_documents(df, vocabulary(A), vocabulary(B))) == brute(rows)


def test_blocks_and_merges_of_several_levels(spark, frame):
    # Small limits make every path of the external counting run; they travel with the task's closure.
    names = {"RUN_DOCS": 2, "FAN_IN": 2, "SLICE": 2, "BLOCK": 3, "CUT": 7, "REMEMBERED": 3}
    rows = list(enumerate(["the same words again and again " * 5, *filter(None, ODD), "again the same\nwords"] * 2))

    def small(batches):
        for name, value in names.items():
            setattr(alignment, name, value)
        return batches

    kept = {name: getattr(alignment, name) for name in names}
    try:
        small(None)
        df = frame(rows).repartition(2)
        # The workers of this pass hold the small limits as well.
        spark.range(0, 64, 1, 16).mapInArrow(lambda b: small(b), "id long").count()
        assert found(alignment.align_documents(df, vocabulary(A), vocabulary(B))) == brute(rows)
    finally:
        for name, value in kept.items():
            setattr(alignment, name, value)
        spark.range(0, 64, 1, 16).mapInArrow(lambda b: ([setattr(alignment, k, v) for k, v in kept.items()], b)[1], "id long").count()


def test_blocks_of_a_long_text():
    aligner = alignment.Aligner(vocabulary(A), vocabulary(B))
    text = " ".join(f"word{i % 977} and\nline {'  ' if i % 1000 == 0 else ''}x" for i in range(20_000))
    whole = aligner.block(text)
    (n_a, n_b, n_groups, n_links, digest), pairs, times = alignment._document(aligner, text)
    assert (n_a, n_b, n_groups) == (whole.n_a, whole.n_b, whole.n_groups)
    assert digest == hashlib.sha256(whole.groups).hexdigest()
    assert n_links == times.sum() == len(whole.pairs) // 8



def test_table_of_pairs(spark, frame):
    rows = [(0, "a b"), (1, "a b"), (2, "a c")]
    everything = alignment.runs(frame(rows), vocabulary(A), vocabulary(B))
    table = alignment.merged(everything.where("part IS NOT NULL").select("part", "run", "pairs"))
    assert sorted(r["n_docs"] for r in alignment.counts(table).collect()) == [1, 2, 3]


def test_empty_table(spark, frame):
    assert alignment.align_documents(frame([]), vocabulary(A), vocabulary(B)).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 3000]
    df = docs.where("text IS NULL OR length(text) < 3000")
    assert found(alignment.align_documents(df, vocabulary(A), vocabulary(B))) == brute(rows)
