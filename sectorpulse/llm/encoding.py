"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

Both vocabularies split a text before they merge symbols, and the splitting never joins characters
across certain places. A text is cut there, each piece is encoded by the library, and a piece seen
before comes from the memo. The ids are those of the whole text.

* Byte-level splitting: before a blank or line feed that stands between two characters that are no
  white space. A text with other or with neighbouring white space is cut before every run of it.
* Word splitting: white space itself, which this tokenizer drops.

Both also split between letters and a punctuation mark. So a piece of Latin letters and one mark at its
end takes its ids from those of the letters and of the mark.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

from sectorpulse.llm.common import Memo

#: The white space of Unicode; Python's own classes also hold \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = re.compile(r"[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SEPARATORS = re.compile(r"[\x1c-\x1f]")
SPACES = re.compile(f"[{SPACE}]+")


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Latin letters, of which every version of Unicode has the same ones, and marks.
LATIN_END, MARKS = "\u024f", ",.;:!?"
#: Entries of the memo of pieces, with keys and ids some 170 MB in a worker; rarer kinds have a fifth.
PIECE_ENTRIES = 800_000


class Pieces(Memo):
    """piece -> ids of ``lead`` + piece as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, lead: str = "", entries: int = PIECE_ENTRIES):
        tokenizer = library(path)

        def ids(piece: str) -> bytes:
            if piece[-1:] in marks and (letters := piece[:-1]).isalpha() and max(letters) <= LATIN_END:
                return self[letters] + marks[piece[-1]]
            # One by one: a batch of one piece costs a third more.
            return array("I", tokenizer.encode(lead + piece, add_special_tokens=False).ids).tobytes()

        marks: dict[str, bytes] = {}
        super().__init__(ids, entries)
        for mark in MARKS:
            (found,) = tokenizer.encode_batch_fast([mark], add_special_tokens=False)
            marks[mark] = array("I", found.ids).tobytes()


@cache
def byte_level(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit integers, for a byte-level vocabulary."""
    blank = Pieces(path, " ")
    whole, line = Pieces(path, "", PIECE_ENTRIES // 5), Pieces(path, "\n", PIECE_ENTRIES // 5)

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return b"".join(map(whole.__getitem__, PIECES.findall(text)))
        out = []
        head = whole
        for row in text.split("\n"):
            pieces = row.split(" ")
            out.append(head[pieces[0]])
            out.extend(map(blank.__getitem__, pieces[1:]))
            head = line
        return b"".join(out)

    return encode


def words(text: str) -> list[str]:
    """The runs of ``text`` that hold no white space."""
    if SEPARATORS.search(text):
        return [x for x in SPACES.split(text) if x]
    return text.split()


@cache
def word_level(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit integers, for a vocabulary that drops white space."""
    memo = Pieces(path)

    def encode(text: str) -> bytes:
        return b"".join(map(memo.__getitem__, words(text)))

    return encode
