"""Operator 2: the template language, reversible escapes and digests by hand."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sectorpulse.llm import chat
from sectorpulse.llm.templates import Const, Output, TemplateError, compile_template, fold, parse

MARKS = ["\\", "#", "##", "###", "### ", "</turn>", "<", "/turn>", ":", ": ", "\n", "a", "é", "🙂", "### user: "]
written = st.lists(st.sampled_from(MARKS), max_size=14).map("".join)


def render(text, **inputs):
    return "".join(piece for piece, _ in compile_template(text, chat.FILTERS)(inputs))


@given(written, written, st.integers(0, 60))
def test_escapes_are_reversible(role, text, at):
    assert chat.unescape(chat.escape(text)) == text
    messages = [{"role": role, "text": text}, {"role": "assistant", "text": text}]
    whole = render(chat.TEMPLATE, messages=messages)
    assert list(chat._turns([{"text": whole[:at]}, {"text": whole[at:]}])) == [(m["role"], m["text"]) for m in messages]
    plain = chat._Unescaped()
    escaped = chat.escape(text)
    assert plain(escaped[:at]) + plain(escaped[at:]) == text


def test_language():
    text = "{% for m in x %}{{ loop.index }}{% if loop.last %}!{% elif m == 'b' %}B{% else %}{{ m ~ 1 }},{% endif %}{% endfor %}"
    assert render(text, x=["a", "b", "c"]) == "1a1,2B3!" and render(text, x=iter(["c"])) == "1!" and render(text, x=[]) == ""
    assert render("{{ 'a' + 'b' | escape }}{# no #} {%- if 1 == 2 %}x{% endif %}.") == "ab."
    assert render("{% set y = x.a['b'] %}{{ y }}{{ not y in 'z' and true }}{{ none }}", x={"a": {"b": "q"}}) == "qtrue"
    assert render(r"{{ 'it\'s\n' }}") == "it's\n" and render("{{ 2 + 3 }}") == "5"
    assert list(compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": 1})) == [
        ("a", False), ("b", True), ("1", True), ("c", False)
    ]


def test_constants_are_folded():
    text = "a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}d{% endif %}{{ 'e' | escape }}"
    assert fold(parse(text), chat.FILTERS) == (Output(Const("ab1ce")),)


@pytest.mark.parametrize(
    "text",
    ["{{ x", "{% for a %}", "{% if 1 %}", "{{ x.__class__ }}", "{{ f(1) }}", "{% endif %}", "{{ a | nope }}", "{{ 1 + 'a' }}"]
    + ["{% else %}", "{{ }}", "{% %}", "{% while 1 %}", "{% if 1 %}{% endfor %}", "{{ 'open }}", "{{ a b }}", "{% set 1 = 2 %}"],
)
def test_what_is_not_in_the_language(text):
    with pytest.raises(TemplateError):
        compile_template(text, chat.FILTERS)


def test_only_fields_of_mappings_are_read():
    for text in ("{{ x.upper }}", "{{ x['format'] }}", "{{ nothing }}", "{% for c in x %}{% endfor %}"):
        with pytest.raises(TemplateError):
            render(text, x="text")


def test_digests(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a:b\\"]), r.choice(["\\### Assistant: </turn> ok", None, "", "é" * 70]))
            for c in [*range(30), None] for t in range(r.randint(1, 9))]
    rows += [(50, None, "assistant", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (51, 0, "assistant", "z" * 5000)]
    given_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conversation")
    turns = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    formatted = chat.render(given_rows, chunk_chars=50)
    for row in chat.digests(formatted).collect():
        own = turns[row.conversation]
        loss = "".join(text for role, text in own if role == "assistant")
        whole = render(chat.TEMPLATE, messages=[{"role": a, "text": b} for a, b in own])
        assert (row.n_turns, row.loss_chars, row.formatted_chars) == (len(own), len(loss), len(whole))
        assert row.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in own)) and row.loss_sha256 == sha(loss)
    back = {}
    for row in chat.messages(formatted).orderBy("conversation", "place").collect():
        back.setdefault(row.conversation, []).append((row.role, row.text))
    assert back == turns
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.render(empty)).collect() == []
