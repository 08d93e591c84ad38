"""Similar titles without missing one.

Titles of a scope are sorted by size and cut into blocks of at most ``BLOCK_ROWS``. Two blocks meet only if
their sizes allow a similar pair, each such meeting is a task of its own, and its memory is bounded by the
blocks. Inside it matrix products of tiles of the blocks bound what every pair shares. The counts of distinct
two-character pieces mostly give the overlap. Two titles whose matching-blocks ratio reaches ``r`` match in
blocks with ``r / 2`` of their characters in all, and a block of ``l`` characters is ``l - q + 1`` pieces of
``q``. There are few blocks: between two of them a character is not matched, and in long titles, where popular
characters are ignored, each (but one) holds another character than these. So similar titles share most of
their pieces of three or five characters, others few. What passes is bounded by characters, by the longest common
subsequence (of many short titles at once), before the ratio itself is taken. Bounds drop no similar pair.

Nothing is held for a pair but its edge, and between kept titles and later ones only the edge from the first
kept one, as no later claim can change a decision. The driver sees no titles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sectorpulse.rules import defaults
from sectorpulse.session import cut_lineage

#: Titles of a block at most, and of a small one: what a task holds is bounded by two of them.
BLOCK_ROWS, SMALL_BLOCK = 4096, 512
MOST_TASKS = 2000
#: Titles of up to so many characters compared by a product of matrices; of longer ones fewer.
TILE_ROWS, TILE_CHARS = 1024, 512
#: Columns of frequent pieces, and those that all others share.
OWN_COLUMNS, SHARED_COLUMNS = 4096, 1024
#: Columns of hashed longer pieces, by the size of the titles; with more than so many a tile has fewer rows.
LEAST_COLUMNS, MOST_COLUMNS, TILE_COLUMNS = 512, 1 << 17, 4096
#: Sizes of those pieces, and the part of its pieces that a title has to share.
GRAM_SIZES, GOOD_PART = (5, 3), 0.25
#: Characters are counted in so many bins; sizes of the pieces that are counted for a single pair.
BINS, GRAMS = 64, (4, 8)
#: Titles from this length on have popular characters (a rule of the matching-blocks ratio).
POPULAR_FROM = 200
#: So many pairs of titles of up to so many characters are put in order together, with masks up to 64 MB.
FEW_PAIRS, ORDERED_CHARS, MOST_MASKS = 64, 256, 1 << 23
#: Titles whose pieces a task remembers.
REMEMBERED = 1024
_EPS = 1e-9


@dataclass(frozen=True)
class Similarity:
    """Accept at ``jaccard`` alone, or at ``ratio`` together with ``ratio_jaccard``."""

    ratio: float | None = defaults.TITLE_RATIO
    jaccard: float | None = None
    ratio_jaccard: float = 0.0


SAME_STORY = Similarity()
SAME_EVENT = Similarity(
    jaccard=defaults.CLUSTER_JACCARD, ratio_jaccard=defaults.CLUSTER_JACCARD_WITH_RATIO
)


def numbered(title: str) -> list[str]:
    seen: dict[str, int] = {}
    pieces = []
    for first, second in zip(title, title[1:]):
        piece = first + second
        seen[piece] = seen.get(piece, 0) + 1
        pieces.append(f"{piece}{seen[piece]}")
    return pieces


@F.pandas_udf(T.IntegerType())
def set_size(titles: pd.Series) -> pd.Series:
    """Distinct two-character pieces of each title."""
    return titles.map(lambda title: len(set(map("".join, zip(title, title[1:])))) or 1)


def features(titles: DataFrame) -> DataFrame:
    """Distinct titles (tk, p, title, first_rank, last_rank) with their sizes."""
    return cut_lineage(titles.withColumns({"chars": F.length("title"), "n": set_size("title")}))


def _prefix_size(kind: str, similarity: Similarity):
    """How many of its rarest pieces a title must offer so that no partner can be missed."""
    if kind == "jaccard":
        t = similarity.jaccard
        return lambda pieces, chars: pieces - math.ceil(t * pieces - _EPS) + 1
    r = similarity.ratio

    def size(pieces: int, chars: int) -> int:
        shortest = chars + math.ceil(chars * r / (2 - r) - _EPS)
        return pieces - max(1, math.ceil((1.5 * r - 1) * shortest - 1 - _EPS)) + 1

    return size


def may_resemble(titles: list[tuple[str, str]], similarity: Similarity = SAME_STORY):
    """A test (scope, title) -> could the ratio to one of the given (scope, title) be reached.

    Pieces are ordered by how often the given titles hold them, so those they do not hold come first and
    the rarest pieces of most other titles meet nothing. Any one order loses no partner.
    """
    size, ratio = _prefix_size("ratio", similarity), similarity.ratio
    held = [(scope, title, numbered(title)) for scope, title in titles]
    count = Counter(piece for _, _, pieces in held for piece in pieces)

    def prefix(title: str, pieces: list[str]) -> list[str]:
        ordered = sorted(pieces, key=lambda piece: (count.get(piece, 0), piece))
        return ordered[: max(0, size(len(ordered), len(title)))]

    lengths: dict[tuple[str, str], set[int]] = {}
    for scope, title, pieces in held:
        for piece in prefix(title, pieces):
            lengths.setdefault((scope, piece), set()).add(len(title))

    def test(scope: str, title: str) -> bool:
        own = len(title)
        for piece in prefix(title, numbered(title)):
            for other in lengths.get((scope, piece), ()):
                if 2 * min(own, other) >= ratio * (own + other) - _EPS:
                    return True
        return False

    return test


def pair_load(titles: DataFrame, limits: list[int] | None = None) -> list[int]:
    """Pairs of one scope if only titles first seen up to each limit took part (no limit: all)."""
    if limits is None:
        taken = {"n0": F.count(F.lit(1))}
    else:
        taken = {f"n{i}": F.count_if(F.col("first_rank") <= x) for i, x in enumerate(limits)}
    counts = titles.groupBy("p").agg(*[c.alias(n) for n, c in taken.items()])
    half = [F.sum(F.col(n) * (F.col(n) - 1) / 2).alias(n) for n in taken]
    return [int(value or 0) for value in counts.agg(*half).first()]


def _reaches(matcher: SequenceMatcher, threshold: float) -> bool:
    """Does the matching-blocks ratio reach the threshold? Stops once it no longer can."""
    a, b = matcher.a, matcher.b
    total = len(a) + len(b)
    matched, possible, open_parts = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while open_parts:
        a_low, a_high, b_low, b_high = part = open_parts.pop()
        possible -= min(a_high - a_low, b_high - b_low)
        i, j, size = matcher.find_longest_match(*part)
        if size:
            rest = ((a_low, i, b_low, j), (i + size, a_high, j + size, b_high))
            open_parts += [r for r in rest if r[0] < r[1] and r[2] < r[3]]
            matched += size
            possible += sum(min(r[1] - r[0], r[3] - r[2]) for r in rest)
        if 2.0 * (matched + possible) / total < threshold:
            return False
    return 2.0 * matched / total >= threshold


class Comparison:
    """Exact tests of pairs of titles; what was made of a title is remembered for a while."""

    def __init__(self, similarity: Similarity):
        self.similarity = similarity
        self.pieces = lru_cache(maxsize=REMEMBERED)(lambda t: frozenset(map("".join, zip(t, t[1:]))) or frozenset([t]))
        self.chars = lru_cache(maxsize=REMEMBERED)(Counter)
        self.grams = lru_cache(maxsize=REMEMBERED)(self._grams)
        self.masks = lru_cache(maxsize=256)(self._masks)
        self.matcher = lru_cache(maxsize=256)(lambda b: SequenceMatcher(None, "", b))

    @staticmethod
    def _grams(title: str, size: int) -> frozenset:
        seen: Counter = Counter()
        found = []
        for i in range(len(title) - size + 1):
            gram = title[i : i + size]
            seen[gram] += 1
            found.append((gram, seen[gram]) if seen[gram] > 1 else gram)
        return frozenset(found)

    @staticmethod
    def _masks(title: str) -> dict[str, int]:
        bits: dict[str, int] = {}
        for i, c in enumerate(title):
            bits[c] = bits.get(c, 0) | 1 << i
        return bits

    def overlap(self, a: str, b: str) -> float:
        x, y = self.pieces(a), self.pieces(b)
        shared = len(x & y)
        return shared / (len(x) + len(y) - shared)

    def common(self, a: str, b: str) -> int:
        """Length of the longest common subsequence, bit-parallel."""
        masks, v = self.masks(b), (1 << len(b)) - 1
        for c in a:
            y = v & masks.get(c, 0)
            v = (v + y) | (v - y)
        return len(b) - (v & ((1 << len(b)) - 1)).bit_count()

    def reaches(self, a: str, b: str) -> bool:
        """Does the ratio of a kept title ``a`` and a new one ``b`` reach the threshold?"""
        ratio, total = self.similarity.ratio, len(a) + len(b)
        if 2 * min(len(a), len(b)) < ratio * total - _EPS:
            return False
        least = math.ceil(ratio * total / 2 - _EPS)
        matcher = self.matcher(b)
        if matcher.bpopular:
            # Every matching block but one at both beginnings holds a character that is not popular.
            held = self.chars(a)
            blocks = 1 + sum(min(held[c], len(at)) for c, at in matcher.b2j.items() if c in held)
            for size in GRAMS:
                wanted = least - blocks * (size - 1)
                if wanted > 0 and len(self.grams(a, size) & self.grams(b, size)) < wanted:
                    return False
        if self.common(a, b) < least:
            return False
        matcher.set_seq1(a)
        return _reaches(matcher, ratio)

    def __call__(self, a: str, b: str) -> bool:
        """Does a kept title ``a`` take a new one ``b``?"""
        jaccard, ratio = self.similarity.jaccard, self.similarity.ratio
        overlap = self.overlap(a, b) if jaccard is not None or self.similarity.ratio_jaccard else 1.0
        if jaccard is not None and overlap >= jaccard:
            return True
        return ratio is not None and overlap >= self.similarity.ratio_jaccard and self.reaches(a, b)


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all titles, whose they are, and the titles' lengths."""
    lengths = np.array([len(t) for t in titles])
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(titles)), lengths), lengths


def _piece_table(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """Per distinct two-character piece of a title its owner and column, with the pieces of each title.

    Pieces that only one title holds have no column. ``exact``: no two pieces share a column.
    """
    codes, owner, lengths = _codes(titles)
    inside = owner[:-1] == owner[1:]
    piece = (codes[:-1] << np.uint64(32) | codes[1:])[inside]
    # A title of one character is its own piece.
    single = lengths[owner] == 1
    piece = np.concatenate([piece, codes[single] << np.uint64(32) | np.uint64(0xFFFFFFFF)])
    owner = np.concatenate([owner[:-1][inside], owner[single]])
    kinds, at = np.unique(piece, return_inverse=True)
    held = np.unique(owner * len(kinds) + at)
    owner, at = held // len(kinds), held % len(kinds)
    n = np.bincount(owner, minlength=len(titles))
    counts = np.bincount(at, minlength=len(kinds))
    common = counts > 1
    column, width = np.cumsum(common) - 1, int(common.sum())
    exact = width <= OWN_COLUMNS
    if not exact:
        # The frequent pieces have columns of their own, others share some: products only get larger.
        place = np.argsort(np.argsort(-counts, kind="stable"))
        column, width = np.where(place < OWN_COLUMNS, place, OWN_COLUMNS + place % SHARED_COLUMNS), OWN_COLUMNS + SHARED_COLUMNS
    kept = common[at]
    return owner[kept], column[at[kept]], n, width, exact


def _gram_table(titles: list[str], size: int, width: int) -> np.ndarray:
    """Titles by columns of hashed pieces of ``size`` characters, each numbered among its like in the title.

    Pieces that meet in a column only make products of rows larger than what two titles share.
    """
    codes, owner, _ = _codes(titles)
    n = max(0, len(codes) - size + 1)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = (key + codes[i : n + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    inside = owner[:n] == owner[size - 1 : size - 1 + n]
    # The same bits of a piece in every tile, whatever the number of its titles.
    bits = np.uint64((TILE_ROWS - 1).bit_length())
    key = np.sort(key[inside] >> bits << bits | owner[:n][inside].astype(np.uint64))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    before = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    owner = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    hashed = ((key >> bits) + before.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    column = (hashed >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)
    return np.bincount(owner * width + column, minlength=len(titles) * width).reshape(len(titles), width).astype(np.float32)


def _starters(titles: list[str]) -> np.ndarray:
    """At how many places of a title a matching block can be found: of long ones popular characters are ignored."""
    codes, owner, lengths = _codes(titles)
    held, counts = np.unique(owner.astype(np.uint64) << np.uint64(32) | codes, return_counts=True)
    whose = (held >> np.uint64(32)).astype(np.int64)
    rare = (lengths[whose] < POPULAR_FROM) | (counts <= lengths[whose] // 100 + 1)
    return np.bincount(whose[rare], weights=counts[rare], minlength=len(titles))


def _histograms(titles: list[str]) -> np.ndarray:
    codes, owner, _ = _codes(titles)
    return np.bincount(owner * BINS + (codes % np.uint64(BINS)).astype(np.int64), minlength=len(titles) * BINS).reshape(
        len(titles), BINS
    )


def _common_order(titles: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Lengths of the longest common subsequences of many pairs of short titles, bit-parallel in words of 63 bits.

    None if a table of their characters would be too large.
    """
    (firsts, at), (seconds, of) = (np.unique(side, return_inverse=True) for side in (x, y))
    names = [titles[i] for i in np.concatenate([firsts, seconds])]
    codes, owner, lengths = _codes(names)
    kinds, code = np.unique(codes, return_inverse=True)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = int(-(-lengths[len(firsts) :].max() // 63))
    if words * len(seconds) * (len(kinds) + 1) > MOST_MASKS:
        return None
    # The last kind is what is beyond the end of a title.
    spelled = np.full((len(firsts), int(lengths[: len(firsts)].max())), len(kinds))
    first = owner < len(firsts)
    spelled[owner[first], place[first]] = code[first]
    masks = np.zeros((words, len(seconds), len(kinds) + 1), np.uint64)
    bit = np.uint64(1) << (place[~first] % 63).astype(np.uint64)
    np.bitwise_or.at(masks, (place[~first] // 63, owner[~first] - len(firsts), code[~first]), bit)
    full, found = np.uint64((1 << 63) - 1), []
    for part in range(0, len(x), 1 << 12):
        i, j = at[part : part + (1 << 12)], of[part : part + (1 << 12)]
        state = [np.full(len(i), full) for _ in range(words)]
        for k in spelled[i].T:
            carry = np.uint64(0)
            for m, v in enumerate(state):
                hit = v & masks[m][j, k]
                total = v + hit + carry
                state[m] = (total & full) | (v - hit)
                carry = total >> np.uint64(63)
        found.append(sum(np.bitwise_count(full & ~v).astype(np.int64) for v in state))
    return np.concatenate(found)


class Meeting:
    """Two lists of titles (or one with itself), compared tile by tile."""

    def __init__(self, left: list[str], right: list[str] | None, similarity: Similarity):
        self.similarity = similarity
        self.titles = titles = left + (right or [])
        self.chars = np.array([len(t) for t in titles])
        self.start = 0 if right is None else len(left)
        # Short titles share more of their pieces by chance, where a product must not add many by hashing.
        short, long = np.quantile(self.chars, (0.05, 0.9))
        wanted = max(4 * long, 16 * min(long, POPULAR_FROM) if short < POPULAR_FROM else 0)
        self.width = min(MOST_COLUMNS, max(LEAST_COLUMNS, 1 << math.ceil(math.log2(wanted))))
        self.tile = max(min(16, TILE_ROWS), min(TILE_ROWS, TILE_ROWS * TILE_COLUMNS // self.width))
        self.overlaps = similarity.jaccard is not None or bool(similarity.ratio_jaccard)
        self.lefts = self._tiles(0, len(left))
        self.rights = self.lefts if right is None else self._tiles(len(left), len(titles))
        tiles = self.lefts + (self.rights if right is not None else [])
        self.exact = True
        if self.overlaps:
            owner, column, self.n, width, self.exact = _piece_table(titles)
            if similarity.jaccard is not None:
                self.needed = self._needed(similarity.jaccard, 2 * int(self.n.max()))
            ends = np.searchsorted(owner, [i for tile in tiles for i in tile])
            self.pieces = {
                (low, high): np.bincount(
                    (owner[x:y] - low) * width + column[x:y], minlength=(high - low) * width
                ).reshape(high - low, width).astype(np.float32)
                for (low, high), x, y in zip(tiles, ends[::2], ends[1::2])
            }
        if similarity.ratio is not None:
            self.starters = _starters(titles)
            self.bins = _histograms(titles)
            self.size = self._gram_size()
            self.grams = {(low, high): _gram_table(titles[low:high], self.size, self.width) for low, high in tiles}

    def _tiles(self, low: int, high: int) -> list[tuple[int, int]]:
        return [(at, min(at + self.tile, high)) for at in range(low, high, self.tile)]

    def _gram_size(self) -> int:
        """The longest pieces of which similar titles must still share a good part."""
        ratio = self.similarity.ratio
        blocks = 1 + np.minimum(2 * (1 - ratio) * self.chars, self.starters)
        for size in GRAM_SIZES:
            if np.mean(ratio * self.chars - (size - 1) * blocks >= GOOD_PART * self.chars) >= 0.95:
                return size
        return 2

    def pairs(self, i: tuple[int, int], j: tuple[int, int], within: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of two tiles: which pairs are similar for sure by pieces (a table), and pairs still to be tested."""
        similarity, (a, b), (c, d) = self.similarity, i, j
        upper = np.triu(np.ones((b - a, d - c), bool), 1) if within and i == j else None
        sure, tested = np.zeros((b - a, d - c), bool), []
        by_ratio = similarity.ratio is not None and self._sizes_meet(self.chars, i, j, similarity.ratio / (2 - similarity.ratio))
        shared = self.pieces[i] @ self.pieces[j].T if self.overlaps else None
        if similarity.jaccard is not None and self._sizes_meet(self.n, i, j, similarity.jaccard):
            reached = shared >= self.needed[np.add.outer(self.n[a:b], self.n[c:d])]
            if upper is not None:
                reached &= upper
            if self.exact:
                sure = reached
            else:
                tested.append(np.nonzero(reached))
        if by_ratio:
            close = self.grams[i] @ self.grams[j].T >= self._wanted(i, j)
            if upper is not None:
                close &= upper
            for more in (sure, *tested):
                close[more] = False
            x, y = np.nonzero(close)
            r, first, second = similarity.ratio, self.chars[x + a], self.chars[y + c]
            kept = 2 * np.minimum(first, second) >= r * (first + second) - _EPS
            if similarity.ratio_jaccard:
                both = np.minimum(shared[x, y], np.minimum(self.n[x + a], self.n[y + c])).astype(np.float64)
                kept &= both / (self.n[x + a] + self.n[y + c] - both) >= similarity.ratio_jaccard
            tested.append(self._in_order(*self._near(x[kept], y[kept], a, c), a, c))
        return sure, np.array([np.concatenate([np.zeros(0, int), *[t[k] for t in tested]]) for k in (0, 1)])

    def _wanted(self, i: tuple[int, int], j: tuple[int, int]) -> np.ndarray:
        """How many hashed pieces titles of two tiles share at least, if their ratio can be reached."""
        r, steps = self.similarity.ratio, self.size - 1
        x, y = self.chars[slice(*i)], self.chars[slice(*j)]
        # By the characters that are not matched, in halves for either title; less than a piece for rounding.
        halves = [((r / 2 - steps * (1 - r)) * side - steps / 2 - 0.1).astype(np.float32) for side in (x, y)]
        wanted = np.add.outer(*halves)
        if max(x.max(), y.max()) >= POPULAR_FROM:
            halves = [(r / 2 * side - steps / 2 - 0.1).astype(np.float32) for side in (x, y)]
            starts = [(steps * self.starters[slice(*tile)]).astype(np.float32) for tile in (i, j)]
            np.maximum(wanted, np.add.outer(*halves) - np.maximum.outer(*starts), out=wanted)
        return wanted

    @staticmethod
    def _needed(least: float, most: int) -> np.ndarray:
        """By the sum of two titles' pieces: how many they share at least, if the overlap (in doubles) is reached."""
        total = np.arange(most + 1, dtype=np.float64)
        needed = np.ceil(least * total / (1 + least)) + 1
        for _ in range(3):
            fewer = np.maximum(needed - 1, 0)
            needed = np.where((total > 0) & (fewer / np.maximum(total - fewer, 1) >= least), fewer, needed)
        return needed.astype(np.float32)

    @staticmethod
    def _sizes_meet(sizes: np.ndarray, i: tuple[int, int], j: tuple[int, int], share: float) -> bool:
        x, y = sizes[slice(*i)], sizes[slice(*j)]
        return x.max() >= share * y.min() - _EPS and y.max() >= share * x.min() - _EPS

    def _near(self, x: np.ndarray, y: np.ndarray, a: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that share enough characters."""
        r, kept = self.similarity.ratio, np.zeros(len(x), bool)
        for at in range(0, len(x), 1 << 16):
            i, j = x[at : at + (1 << 16)] + a, y[at : at + (1 << 16)] + c
            both = np.minimum(self.bins[i], self.bins[j]).sum(axis=1)
            kept[at : at + (1 << 16)] = 2 * both >= r * (self.chars[i] + self.chars[j]) - _EPS
        return x[kept], y[kept]

    def _in_order(self, x: np.ndarray, y: np.ndarray, a: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that share enough characters in the same order, as far as titles are short."""
        short = np.maximum(self.chars[x + a], self.chars[y + c]) <= ORDERED_CHARS
        if short.sum() < FEW_PAIRS:
            return x, y
        kept, at = ~short, np.flatnonzero(short)
        common = _common_order(self.titles, x[at] + a, y[at] + c)
        least = self.similarity.ratio * (self.chars[x[at] + a] + self.chars[y[at] + c]) - _EPS
        kept[at] = True if common is None else 2 * common >= least
        return x[kept], y[kept]

    def may_meet(self, i: tuple[int, int], j: tuple[int, int]) -> bool:
        """Do the sizes in two tiles allow a similar pair?"""
        s = self.similarity
        if s.jaccard is not None and self._sizes_meet(self.n, i, j, s.jaccard):
            return True
        return s.ratio is not None and self._sizes_meet(self.chars, i, j, s.ratio / (2 - s.ratio))


def _block_edges(similarity: Similarity, within: bool):
    """Edges between the titles of two blocks (one block: ``side`` is 0 throughout)."""

    def inside(a: pd.DataFrame, b: pd.DataFrame, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = a["title"].tolist(), b["title"].tolist()
        meeting, test = Meeting(left, None if alone else right, similarity), Comparison(similarity)
        start = meeting.start
        x, y = (np.array(side["tk"], object) for side in (a, b))
        (xf, xl), (yf, yl) = ((side["first_rank"].to_numpy(), side["last_rank"].to_numpy()) for side in (a, b))
        for i in meeting.lefts:
            for j in meeting.rights:
                if (alone and j < i) or not meeting.may_meet(i, j):
                    continue
                low, high, first, last = *i, j[0] - start, j[1] - start
                sure, maybe = meeting.pairs(i, j, alone)
                # A title can only take another one that shows up after it.
                onward = sure & np.less.outer(xf[low:high], yl[first:last])
                back = sure & np.less.outer(yf[first:last], xl[low:high]).T
                # By the second title, whose description is remembered.
                for k, m in maybe[:, np.argsort(maybe[1], kind="stable")].T.tolist():
                    if xf[low + k] < yl[first + m]:
                        onward[k, m] = test(left[low + k], right[first + m])
                for k, m in maybe[:, np.argsort(maybe[0], kind="stable")].T.tolist():
                    if yf[first + m] < xl[low + k]:
                        back[k, m] = test(right[first + m], left[low + k])
                (k, m), (p, q) = np.nonzero(onward), np.nonzero(back)
                yield x[low + k], y[first + m]
                yield y[first + q], x[low + p]

    def across(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # In the order of what was kept; the first one that takes a title is all that counts.
        left, right = a["title"].tolist(), b["title"].tolist()
        meeting, test = Meeting(left, right, similarity), Comparison(similarity)
        x, y = (np.array(side["tk"], object) for side in (a, b))
        name = pd.factorize(np.concatenate([x, y]))[0]
        place = np.argsort(np.argsort(a["rank"].to_numpy(), kind="stable"), kind="stable")
        order = np.argsort(place)
        for j in meeting.rights:
            first = j[0] - meeting.start
            best = np.full(j[1] - j[0], len(left))
            tried = []
            for i in meeting.lefts:
                if not meeting.may_meet(i, j):
                    continue
                sure, maybe = meeting.pairs(i, j, False)
                sure &= np.not_equal.outer(name[slice(*i)], name[slice(*j)])
                if sure.any():
                    best = np.minimum(best, np.where(sure, place[slice(*i), None], len(left)).min(axis=0))
                k, m = maybe
                own = name[i[0] + k] != name[j[0] + m]
                tried.append((place[i[0] + k[own]], m[own]))
            if tried:
                p, m = (np.concatenate([t[k] for t in tried]) for k in (0, 1))
                by = np.lexsort((p, m))
                for k, at in zip(p[by].tolist(), m[by].tolist()):
                    if k < best[at] and test(left[order[k]], right[first + at]):
                        best[at] = k
            hit = best < len(left)
            yield x[order[best[hit]]], y[first : first + len(best)][hit]

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        alone = within and not len(b)
        if not len(a) or not (alone or len(b)):
            return pd.DataFrame({"src": [], "dst": []})
        # Tiles hold titles of like size.
        a, b = (side.iloc[np.argsort(side["title"].str.len(), kind="stable")] for side in (a, b))
        parts = list(inside(a, a if alone else b, alone) if within else across(a, b))
        src, dst = (np.concatenate([np.zeros(0, object), *[part[k] for part in parts]]) for k in (0, 1))
        return pd.DataFrame({"src": src, "dst": dst})

    return found


def _in_blocks(titles: DataFrame, similarity: Similarity, most: int) -> DataFrame:
    """``titles`` with the number of their block; a block has titles of like size of one scope (p, block).

    A block has at most ``most`` titles, and fewer of longer ones: half as many for each doubling.
    """
    by = "chars" if similarity.jaccard is None else "n"
    halved = F.greatest(F.lit(0), F.ceil(F.log2(F.col("chars") / TILE_CHARS))).cast("int")
    ordered = titles.withColumn("halved", halved).orderBy("p", "halved", by, "tk")
    numbered_rows = ordered.withColumn("at", F.monotonically_increasing_id())
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = F.greatest(F.lit(1), F.floor(F.lit(most) / F.pow(F.lit(2), F.col("halved"))))
    block = F.col("at") - within + F.floor(within / rows)
    return cut_lineage(numbered_rows.withColumn("block", block).drop("at", "halved"))


def _block_sizes(blocked: DataFrame, name: str) -> DataFrame:
    sizes = [f(c).alias(f"{name}_{c}_{f.__name__}") for c in ("chars", "n") for f in (F.min, F.max)]
    return blocked.groupBy("p", F.col("block").alias(name)).agg(*sizes)


def _may_meet(similarity: Similarity) -> Column:
    """Do the sizes in two blocks a and b allow a similar pair?"""

    def near(what: str, share: float) -> Column:
        return (F.col(f"a_{what}_max") >= share * F.col(f"b_{what}_min") - _EPS) & (
            F.col(f"b_{what}_max") >= share * F.col(f"a_{what}_min") - _EPS
        )

    met = F.lit(False)
    if similarity.jaccard is not None:
        met |= near("n", similarity.jaccard)
    if similarity.ratio is not None:
        met |= near("chars", similarity.ratio / (2 - similarity.ratio)) & near("n", similarity.ratio_jaccard)
    return met


def similar_edges(
    titles: DataFrame,
    similarity: Similarity,
    leaders: DataFrame | None = None,
    others: DataFrame | None = None,
) -> DataFrame:
    """Directed (src, dst): a kept title ``src`` takes a later title ``dst``.

    Within ``titles`` by default, all edges. With ``leaders`` (tk, rank) and ``others`` (tk) from the ones to the
    others: of the edges to a title at least that of the first leader.
    """
    within = leaders is None
    least = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few titles are cut into small blocks, so that there are some more meetings than tasks.
    most = max(min(BLOCK_ROWS, SMALL_BLOCK), min(BLOCK_ROWS, int(titles.count() / (5 * math.sqrt(least)))))
    if within:
        left = right = _in_blocks(titles.withColumn("rank", F.col("first_rank")), similarity, most)
    else:
        left = _in_blocks(titles.join(leaders, "tk"), similarity, most)
        later = titles.join(others, "tk", "left_semi").withColumn("rank", F.col("first_rank"))
        right = _in_blocks(later, similarity, most)
    met = _may_meet(similarity) & (F.col("a") <= F.col("b") if within else F.lit(True))
    # A row for two blocks of thousands of titles.
    pairs = cut_lineage(
        _block_sizes(left, "a").join(_block_sizes(right, "b"), "p").filter(met).select("p", "a", "b")
    )
    columns = ("p", "a", "b", "side", "tk", "title", "first_rank", "last_rank", "rank")
    sides = [
        left.join(pairs, [left["p"] == pairs["p"], left["block"] == pairs["a"]]).drop(pairs["p"]),
        right.join(pairs, [right["p"] == pairs["p"], right["block"] == pairs["b"]]).drop(pairs["p"]),
    ]
    if within:
        sides[1] = sides[1].filter("a != b")
    rows = reduce(
        DataFrame.unionByName, [side.withColumn("side", F.lit(i)).select(*columns) for i, side in enumerate(sides)]
    )
    # Few rows can be much work, so meetings are dealt to as many tasks as there are.
    tasks = min(MOST_TASKS, max(least, pairs.count()))
    dealt = rows.repartition(tasks, "p", "a", "b").groupBy("p", "a", "b")
    return cut_lineage(dealt.applyInPandas(_block_edges(similarity, within), "src binary, dst binary"))
