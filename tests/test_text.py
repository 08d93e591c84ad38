"""Scalar functions against plain Python equivalents."""

import html
import random
import re
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import functions as F

from sectorpulse.functions import ids, text, times


def run(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


ENTITIES = [
    "a &amp; b", "&lt;b&gt;", "&quot;x&quot;", "&#39;", "&#x4e2d;&#25991;", "&nbsp;x", "&copy;2024",
    "&middot;", "&notit;", "&notin;", "&am", "&", "&&amp;&", "a&amp", "&#0;", "&#13;", "&#128;",
    "&#129;", "&#xD800;", "&#x110000;", "&#99999999999999;", "&#1;", "&#xFFFE;", "&#x1F600;",
    "&AMP", "&ampx", "&unknown;", "&Aacute", "&acE;", "no entity", "", "&#;", "&#x;", "&#000065;",
]


def test_unescape_equals_stdlib(spark):
    rng = random.Random(7)
    pieces = ["&", "amp", ";", "#", "x", "41", "lt", "not", "it", " ", "<", "&copy", "&#x3b1;", "é", "中"]
    values = ENTITIES + ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(400)]
    assert run(spark, values, text.unescape) == [html.unescape(v) for v in values]


def test_fold_equals_casefold(spark):
    values = ["Straße", "ΣΑΣ ς", "ſµ", "İI", "ﬁn ŉ ΐ", "NVIDIA 中文", "Ａｐｐ"]
    assert run(spark, values, text.fold) == [v.casefold() for v in values]


def py_clean(v):
    t = html.unescape(v or "")
    for tag in ("<em>", "</em>", "<span>", "</span>"):
        t = t.replace(tag, "")
    return " ".join(t.split())


def test_clean_text(spark):
    values = ["  <em>国际</em>　油价\xa0 大涨\r\n", "a\tb\x0bc\x1cd\x85e", "&lt;em&gt;x&lt;/em&gt;", "<span>y</span>", None]
    assert run(spark, values, text.clean_text) == [py_clean(v) for v in values]


def py_link(v):
    link = py_clean(v)
    if not link:
        return ""
    u = urlsplit(link)
    if u.scheme or u.netloc:
        return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path.rstrip("/"), "", ""))
    return link.split("?", 1)[0].split("#", 1)[0].rstrip("/")


def test_link_key(spark):
    values = [
        "http://E.com/a/", "http://e.com/a?from=share", "HTTPS://X.org/P/?q#f", "//cdn.X.com/z/", "/rel/path/?x",
        "rel#frag", "http://e.com", "http://e.com/?a=/b", "e.com/a b/", "mailto:Me@X.com", "", None,
        "https://u:p@h:80//d//", "http://a.b/c&amp;d", "1http://x/y?z", "http://e.com/a;p=1?q",
    ]
    assert run(spark, values, text.link_key) == [py_link(v) for v in values]
    assert run(spark, ["http://f.cn/t#ab1"], lambda c: text.link_key(c, keep_fragment=True)) == ["http://f.cn/t#ab1"]


def test_title_key_drops_moves_and_noise(spark):
    values = ["快讯：半导体板块拉升 3.5%！", "油价上涨2.1个百分点 至80美元", "最新 A_B-c", "跌超+5%", "午评盘中异动", "Straße 5%"]
    expected = ["半导体板块", "油价至80美元", "abc", "", "", "strasse"]
    assert run(spark, values, text.title_key) == expected
    assert run(spark, ["A <b>x</b>_中、文!"], text.text_key) == ["ax中文"]


def test_bigrams_and_jaccard(spark):
    assert run(spark, ["", "a", "ab", "abab"], text.bigrams) == [[], ["a"], ["ab"], ["ab", "ba", "ab"]]
    assert run(spark, ["abab"], text.bigram_set) == [["ab", "ba"]]
    assert run(spark, ["abc"], lambda c: text.jaccard(text.bigram_set(c), F.array(F.lit("ab")))) == [0.5]


def test_split_keywords(spark):
    assert run(spark, ["a, b，c ,, ", None], text.split_keywords) == [["a", "b", "c"], []]


def test_times(spark):
    values = ["2026-07-05 10:00:00", "2026/07/05 10:00:00", "2026-07-05", "10:00", "bad", ""]
    got = [None if t is None else str(t) for t in run(spark, values, times.publish_ts)]
    assert got == ["2026-07-05 10:00:00", "2026-07-05 10:00:00", "2026-07-05 00:00:00", None, None, None]
    values = ["2026-07-05T00:00:00Z", "2026/07/05 00:00:00", "oops", "", None, "无", "2026-07-05T08:00:00+08:00"]
    assert run(spark, values, times.format_utc8) == [
        "2026-07-05 08:00:00 UTC+8", "2026-07-05 08:00:00 UTC+8", "oops", "无", "无", "无", "2026-07-05 08:00:00 UTC+8",
    ]


def test_hashes(spark):
    import hashlib

    assert run(spark, ["http://e.com/a", ""], ids.link_hash) == [
        hashlib.sha1(v.encode()).hexdigest()[:16] for v in ("http://e.com/a", "")
    ]
    got = run(spark, ["标题"], lambda c: ids.stream_link(F.lit("http://f.cn"), c, F.lit("10:00")))
    assert got == ["http://f.cn#" + hashlib.sha1("标题|10:00".encode()).hexdigest()[:12]]


def test_non_word_class(spark):
    sample = "".join(chr(c) for c in range(0x20, 0x870))
    got = run(spark, [sample], lambda c: F.regexp_replace(c, text.NON_WORD, ""))[0]
    assert got == re.sub(r"[\W_]+", "", sample)


def test_strip_and_text_key_of_odd_white_space(spark):
    spaces = [" ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000"]
    values = [a + middle + b for middle in ("", "x y", "<a\n>Σ", "ΑΣ\x1fΣ &amp;<", "İ ẞ\u3000x") for a in ["", *spaces] for b in ["", *spaces]]
    kept = [v.strip() for v in values]
    assert run(spark, [*values, None], text.strip) == [*kept, None]
    collapsed = run(spark, [*values, None], lambda c: F.regexp_replace(F.regexp_replace(text.fold(text.clean_text(c)), text.ANY_TAG, ""), text.NON_WORD, ""))
    assert run(spark, [*values, None], text.text_key) == collapsed
