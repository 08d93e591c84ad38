"""Operator 4, token counts: byte-pair merging of many pre-tokens at once in numpy arrays.

The pre-tokens of a batch that were not met before lie end to end in one array of symbols. In each
round every one of them applies its own lowest-rank pair, wherever it occurs, at the same time; when
no pair has a rank any more, the symbols left are the tokens. Counts by run of characters without
white space are kept in a bounded memo.

Defined results: null text counts as empty and has no tokens; an empty table gives an empty result;
rows that repeat an id are counted each; other columns are ignored. The names of special tokens inside
texts are one token each, as in the library.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import MEMO_ENTRIES, Memo, own_memos, text_or_empty
from sectorpulse.llm.encoding import LATIN_END, library, words

LIMIT = 2048
NO_RANK = np.int64(1 << 62)


def _byte_symbols() -> dict[int, str]:
    """Byte-level symbols: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in symbols)
    return symbols | {b: chr(256 + k) for k, b in enumerate(others)}


class Merger:
    """The vocabulary of a word-level BPE file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.byte_of = {symbol: b for b, symbol in symbols.items()}
        self.library = library(path)
        self.inner = np.array([vocabulary[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[symbols[b] + end] for b in range(256)], np.int64)
        self.size = np.int64(max(vocabulary.values()) + 1)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * int(self.size) + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(split["pattern"]["Regex"])

    def pre_tokens(self, run: str) -> tuple[int, list[bytes]]:
        """(special tokens, pre-tokens in UTF-8) of a run without white space."""
        parts = self.special.split(run) if "<|" in run else [run]
        found = []
        for part in parts:
            if part and max(part) > LATIN_END:
                # Which characters are letters, or compose, depends on the library's version of Unicode.
                split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                found += [bytes(map(self.byte_of.__getitem__, t)) for t, _ in split]
            else:
                found += [t.encode() for t in self.pattern.findall(part.lower())]
        return len(parts) - 1, found

    def counts(self, raw: list[bytes]) -> np.ndarray:
        """Tokens each pre-token is merged to."""
        done = np.zeros(len(raw), np.int64)
        if not raw:
            return done
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(symbols):
            pairs = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            known = (self.keys[at] == pairs) & (owner[:-1] == owner[1:])
            ranks = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            over = lowest == NO_RANK
            done[owner[starts[over]]] = lengths[over]
            live = np.repeat(~over, lengths)
            hit = live & (ranks == np.repeat(lowest, lengths))
            # In a row of overlapping hits every other one merges, from the left.
            places = np.flatnonzero(hit)
            new_row = np.append(True, np.diff(places) != 1)[: len(places)]
            if len(places):
                row_start = places[np.maximum.accumulate(np.where(new_row, np.arange(len(places)), 0))]
                places = places[(places - row_start) % 2 == 0]
            symbols[places] = self.made[at[places]]
            live[places + 1] = False
            symbols, owner = symbols[live], owner[live]
        return done


@cache
def merger(path: str) -> Merger:
    return Merger(path)


class Counter:
    """Token counts of texts; remembers those of runs met before."""

    def __init__(self, path: str):
        self.merger, self.memo = merger(path), Memo()

    def __call__(self, texts: list[str]) -> list[int]:
        runs = [words(text) for text in texts]
        new = list({run for found in runs for run in found if run not in self.memo})
        specials, tokens, owner = [], [], []
        for k, run in enumerate(new):
            special, found = self.merger.pre_tokens(run)
            specials.append(special)
            tokens += found
            owner += [k] * len(found)
        totals = np.bincount(owner, self.merger.counts(tokens), len(new)).astype(int) + specials if new else []
        fresh = dict(zip(new, map(int, totals), strict=True))
        room = MEMO_ENTRIES - len(self.memo)
        if room >= len(fresh):
            self.memo |= fresh
            return [sum(map(self.memo.__getitem__, found)) for found in runs]
        counts = [sum(fresh[run] if run in fresh else self.memo[run] for run in found) for found in runs]
        self.memo |= dict(list(fresh.items())[:room])
        return counts


@cache
def counter(path: str) -> Counter:
    return Counter(path)


COUNTED = "id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters of texts merged at once.
BATCH_CHARS = 2_000_000


def count(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a map, without a shuffle."""

    def counted(batches):
        own_memos("counts")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo = held = 0
            slices, part = [], []
            for k in range(len(texts)):
                part.append(texts[k].as_py())
                held += len(part[-1])
                if held >= BATCH_CHARS or k + 1 == len(texts):
                    slices.append((lo, k + 1, counter(tokenizer)(part)))
                    lo, held, part = k + 1, 0, []
            for lo, hi, counts in slices:
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(counts, pa.int64()),
                        pa.array([n > limit for n in counts], pa.bool_()),
                    ],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    text = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(counted, COUNTED)
