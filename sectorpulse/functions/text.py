"""Text, link and title keys as native column expressions."""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide which titles count as equal.
REMOVED_TAGS = ("<em>", "</em>", "<span>", "</span>")
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
ANY_TAG = r"<[^>]+>"
# ASCII letters and digits by name: a table finds them faster than their Unicode class.
NON_WORD = r"[^a-zA-Z0-9\p{L}\p{N}]+"
PRICE_MOVE = (
    r"(?:上涨|下跌|涨近|涨超|涨逾|跌近|跌超|跌逾|大涨|大跌|拉升|跳水|走强|走弱|涨|跌)"
    r"\s*[+-]?\p{Nd}+(?:\.\p{Nd}+)?\s*(?:%|％|个百分点|点)?"
)
PERCENTAGE = r"[+-]?\p{Nd}+(?:\.\p{Nd}+)?\s*(?:%|％|个百分点)"
TITLE_NOISE = ("最新", "突发", "快讯", "午评", "盘中", "异动", "拉升", "走强", "跳水")

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)"
_BEYOND_UNICODE = 0x110000
_ENTITY_NAME = r"^([^\t\n\f <&#;]{1,32};?)"
_ENTITY_NUMBER = r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?"


def let(column: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times, without repeating its expression."""
    return F.element_at(F.transform(F.array(column), body), 1)


@functools.cache
def _fold_json() -> str:
    """Where case folding goes further than lower-casing, derived from the Unicode data."""
    # Surrogates are no characters, and only what lower() leaves alone is still there afterwards.
    chars = (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    return json.dumps({c: c.casefold() for c in chars if c.lower() == c != c.casefold()})


def _char_class(codes: list[int], gap: int) -> str:
    """Regex class over the codes; codes at most ``gap`` apart share a range."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def fold(column: Column) -> Column:
    """Case folding: lower(), plus the few characters (such as ß) that fold further."""
    further = _json_map(_fold_json())
    codes = [ord(c) for c in json.loads(_fold_json())]
    # A class of few ranges, free of common accents, decides for nearly all texts.
    near, exact = _char_class(codes, 0x69), f"({_char_class(codes, 1)})"

    def finish(lowered: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(exact), F.lit(1)))
        replaced = F.aggregate(
            found, lowered, lambda text, c: F.replace(text, c, F.element_at(further, c))
        )
        # Lower-case ASCII folds no further; of other texts few hold one of the characters.
        plain = F.octet_length(lowered) == F.char_length(lowered)
        return F.when(plain, lowered).when(lowered.rlike(near), replaced).otherwise(lowered)

    return let(F.lower(column), finish)


def fold_word(word: str) -> str:
    """The same folding for a keyword known to the driver."""
    return word.casefold()


@functools.cache
def _entity_json() -> str:
    return json.dumps(html5)


@functools.cache
def _bare_entities() -> str:
    """Names that HTML accepts without the closing semicolon, longest first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return "^(" + "|".join(names) + ")"


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


@functools.cache
def _number_json() -> str:
    """Numeric references HTML maps specially: 0, CR and the 0x80-0x9f block."""
    table = {0: "�", 0x0D: "\r"}
    table.update({code: _windows_1252(code) for code in range(0x80, 0xA0)})
    return json.dumps({str(k): v for k, v in table.items()})


def _json_map(text: str) -> Column:
    # One foldable expression: Spark turns it into a map literal once per query.
    return F.from_json(F.lit(text), "map<string,string>")


def _decode_number(part: Column) -> Column:
    as_hex = F.regexp_extract(part, _ENTITY_NUMBER, 1)
    as_dec = F.regexp_extract(part, _ENTITY_NUMBER, 2)
    digits = F.ltrim(F.concat(as_hex, as_dec), F.lit("0"))
    number = (
        F.when(F.length(digits) > 10, F.lit(_BEYOND_UNICODE))
        .when(digits == "", F.lit(0))
        .otherwise(F.when(as_hex != "", F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
    )
    return F.concat(let(number, _char), F.regexp_replace(part, _ENTITY_NUMBER, ""))


def _char(code: Column) -> Column:
    """The character HTML gives a number: replacement for impossible ones, '' for controls."""
    control = (
        code.between(0x1, 0x8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    remapped = (code == 0) | (code == 0x0D) | code.between(0x80, 0x9F)
    return (
        F.when((code >= _BEYOND_UNICODE) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(remapped, F.try_element_at(_json_map(_number_json()), code.cast("string")))
        .when(control, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _decode_name(part: Column) -> Column:
    """Longest known entity name at the start of the text after '&'."""
    name = F.regexp_extract(part, _ENTITY_NAME, 1)
    names = F.array(name, F.regexp_extract(name, _bare_entities(), 1))
    known = F.filter(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("name"), F.try_element_at(_json_map(_entity_json()), n).alias("char")
            ),
        ),
        lambda hit: hit["char"].isNotNull(),
    )
    return let(
        F.try_element_at(known, F.lit(1)),
        lambda hit: F.coalesce(
            F.concat(hit["char"], part.substr(F.length(hit["name"]) + 1, F.length(part))),
            F.concat(F.lit("&"), part),
        ),
    )


def unescape(column: Column) -> Column:
    """HTML character references to characters; text without '&' is passed through untouched."""

    def decode(part: Column) -> Column:
        plain = F.concat(F.lit("&"), part)
        return (
            F.when(part.rlike("^[A-Za-z][A-Za-z0-9]"), _decode_name(part))
            .when(part.rlike(_ENTITY_NUMBER), _decode_number(part))
            .otherwise(plain)
        )

    def decode_all(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decode)
        return F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(1)), tail), "")

    return F.when(F.contains(column, F.lit("&")), let(F.split(column, "&"), decode_all)).otherwise(
        column
    )


def _untagged(column: Column) -> Column:
    """Unescaped, without highlight tags; NULL becomes ''."""
    text = unescape(F.coalesce(column, F.lit("")))
    for tag in REMOVED_TAGS:
        text = F.replace(text, F.lit(tag), F.lit(""))
    return text


def clean_text(column: Column) -> Column:
    """Unescaped, without highlight tags, whitespace collapsed; NULL becomes ''."""
    return F.trim(F.regexp_replace(_untagged(column), WHITESPACE, " "))


def link_key(column: Column, keep_fragment: bool = False) -> Column:
    """Comparable form of a link: lower-case scheme and host, no query, no trailing slash.

    ``keep_fragment`` keeps '#…', for feeds whose items differ by fragment only.
    """

    def parse(link: Column) -> Column:
        scheme = F.lower(F.regexp_extract(link, _URL, 1))
        authority = F.lower(F.regexp_extract(link, _URL, 2))
        path = F.rtrim(F.regexp_extract(link, _URL, 3), F.lit("/"))
        # An empty authority ('http:///x') is dropped, a non-empty one keeps its slashes.
        host = F.when(authority == "//", F.lit("")).otherwise(authority)
        key = F.concat(scheme, host, path)
        if keep_fragment:
            key = F.concat(key, F.regexp_extract(link, r"(#.*)$", 1))
        return key

    return let(clean_text(column), parse)


def text_key(column: Column) -> Column:
    """Folded letters and digits only."""
    # Whitespace goes with all else that is no letter or digit: it is not collapsed before.
    text = F.regexp_replace(fold(_untagged(column)), ANY_TAG, "")
    return F.regexp_replace(text, NON_WORD, "")


def title_key(column: Column) -> Column:
    """text_key without price moves, percentages and noise words."""
    text = F.regexp_replace(fold(clean_text(column)), ANY_TAG, "")
    text = F.regexp_replace(F.regexp_replace(text, PRICE_MOVE, ""), PERCENTAGE, "")
    for word in TITLE_NOISE:
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.regexp_replace(text, NON_WORD, "")


def bigrams(key: Column) -> Column:
    """All two-character pieces in order, repeats included; a single character is its own piece."""
    pairs = let(
        F.split(key, ""),
        lambda chars: F.zip_with(
            F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))),
            F.slice(chars, F.lit(2), F.size(chars)),
            lambda a, b: F.concat(a, b),
        ),
    )
    return (
        F.when(F.length(key) >= 2, pairs)
        .when(F.length(key) == 1, F.array(key))
        .otherwise(F.array().cast("array<string>"))
    )


def bigram_set(key: Column) -> Column:
    return F.array_distinct(bigrams(key))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two sets given as arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def split_keywords(column: Column) -> Column:
    """'a, b，c' to [a, b, c]."""
    parts = F.split(F.coalesce(column, F.lit("")), "[,，]")
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def strip(column: Column) -> Column:
    """Trim all Unicode whitespace, not only blanks."""
    # Most texts begin and end with something else, and need not be searched for it.
    ends = F.concat(F.substring(column, 1, 1), F.substring(column, -1, 1))
    trimmed = F.regexp_replace(column, f"^{WHITESPACE}|{WHITESPACE}$", "")
    return F.when(ends.rlike(WHITESPACE), trimmed).otherwise(column)
