"""A small sandboxed template language, compiled to Python closures.

Text stands for itself; ``{{ expression }}`` is rendered; ``{% ... %}`` holds statements::

    {% for message in messages %} ... {% endfor %}      {% set name = expression %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}             {# a comment #}

Expressions have names, strings, whole numbers, ``true``, ``false``, ``none``, fields (``message.role``
or ``message['role']``), ``== != and or not in + ~``, parentheses and filters (``text | escape``).
A dash inside a tag (``{%- -%}``) drops the white space next to it. ``loop.index``, ``loop.first``
and ``loop.last`` hold in a loop. There are no calls, no attributes of Python objects and no loops but
those over given sequences, so a template can only read its inputs, and it always ends.

``compile_template`` parses to a syntax tree, folds constant parts (also whole branches and joins of
neighbouring text), and turns what is left into closures. A template is a generator of
(text, inside a generation block) pieces; a loop takes its items one by one, so a long conversation is
never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

Pieces = Iterator[tuple[str, bool]]
Scope = dict[str, object]


class TemplateError(ValueError):
    """The template text is not in the language, or a name or field is missing when it is rendered."""


# -- the syntax tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: object


@dataclass(frozen=True)
class Unary:
    operand: object


@dataclass(frozen=True)
class Binary:
    operator: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    operand: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- parsing -----------------------------------------------------------------------------------------

_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.DOTALL)
_TOKENS = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<operator>==|!=|[()\[\].|+~=]))",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKENS.match(text, at)
            if not found:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def next_is(self, *values: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return kind in ("name", "operator") and value in values

    def accept(self, *values: str) -> str | None:
        if not self.next_is(*values):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or value in _WORDS or value in _CONSTANTS:
            raise TemplateError("a name is missing")
        if value.startswith("_"):
            raise TemplateError(f"{value!r}: names do not begin with an underscore")
        self.at += 1
        return value

    def whole(self):
        found = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"cannot read on from {self.tokens[self.at][1]!r}")
        return found

    def either(self):
        left = self.both()
        while self.accept("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.accept("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self):
        return Unary(self.negated()) if self.accept("not") else self.compared()

    def compared(self):
        left = self.joined()
        while operator := self.accept("==", "!=", "in"):
            left = Binary(operator, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while operator := self.accept("+", "~"):
            left = Binary(operator, left, self.filtered())
        return left

    def filtered(self):
        value = self.atom()
        while True:
            if self.accept("."):
                value = Field(value, Const(self.name()))
            elif self.accept("["):
                value = Field(value, self.either())
                self.expect("]")
            elif self.accept("|"):
                value = Filter(self.name(), value)
            else:
                return value

    def atom(self):
        if self.accept("("):
            value = self.either()
            self.expect(")")
            return value
        if self.at == len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "number":
            self.at += 1
            return Const(int(text))
        if text in _CONSTANTS:
            self.at += 1
            return Const(_CONSTANTS[text])
        return Name(self.name())


@dataclass
class _Open:
    """A block being parsed; ``bodies`` holds (condition, body so far)."""

    kind: str
    head: tuple = ()
    bodies: list = field(default_factory=lambda: [(None, [])])

    @property
    def body(self) -> list:
        return self.bodies[-1][1]


def parse(text: str) -> tuple:
    """The syntax tree of ``text``: a tuple of statements."""
    stack = [_Open("template")]
    trim = False
    pieces = _TAGS.split(text)
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            following = pieces[k + 1] if k + 1 < len(pieces) else ""
            piece = piece.lstrip() if trim else piece
            piece = piece.rstrip() if following[2:3] == "-" else piece
            if any(mark in piece for mark in ("{{", "{%", "{#")):
                raise TemplateError(f"a tag is not closed: {piece!r}")
            if piece:
                stack[-1].body.append(Output(Const(piece)))
            continue
        trim = piece[-3] == "-"
        inside = piece[2:-2].removeprefix("-").removesuffix("-")
        if piece[1] == "{":
            stack[-1].body.append(Output(_Expression(inside).whole()))
        elif piece[1] == "%":
            _statement(_Expression(inside), stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1].kind!r} is not ended")
    return tuple(stack[0].body)


def _statement(tag: _Expression, stack: list[_Open]) -> None:
    if not tag.tokens:
        raise TemplateError("an empty statement")
    word = tag.tokens[0][1]
    tag.at = 1
    if word == "for":
        name = tag.name()
        tag.expect("in")
        stack.append(_Open("for", (name, tag.whole())))
    elif word == "if":
        stack.append(_Open("if", bodies=[(tag.whole(), [])]))
    elif word in ("elif", "else"):
        top = stack[-1]
        if top.kind != "if" or top.bodies[-1][0] == Const(True):
            raise TemplateError(f"{word!r} without 'if'")
        top.bodies.append((tag.whole() if word == "elif" else Const(True), []))
    elif word == "set":
        name = tag.name()
        tag.expect("=")
        stack[-1].body.append(Set(name, tag.whole()))
    elif word == "generation":
        stack.append(_Open("generation"))
    elif word in ("endfor", "endif", "endgeneration"):
        top = stack.pop()
        if top.kind != word[3:]:
            raise TemplateError(f"{word!r} does not end {top.kind!r}")
        bodies = [(condition, tuple(body)) for condition, body in top.bodies]
        made = {"for": lambda: For(*top.head, bodies[0][1]), "if": lambda: If(tuple(bodies))}
        made["generation"] = lambda: Generation(bodies[0][1])
        stack[-1].body.append(made[top.kind]())
    else:
        raise TemplateError(f"unknown statement {word!r}")
    if word in ("else", "generation", "endfor", "endif", "endgeneration") and len(tag.tokens) > 1:
        raise TemplateError(f"{word!r} takes nothing more")


# -- folding -----------------------------------------------------------------------------------------


def shown(value: object) -> str:
    if value is None:
        return ""
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: b is not None and a in b,
    "~": lambda a, b: shown(a) + shown(b),
}


def _add(a: object, b: object) -> object:
    if type(a) is not type(b) or not isinstance(a, (int, str)):
        raise TemplateError("'+' takes two numbers or two strings")
    return a + b


def fold_expression(node, filters: dict[str, Callable]):
    """``node`` with every part that has a constant value replaced by it."""
    if isinstance(node, Unary):
        operand = fold_expression(node.operand, filters)
        return Const(not operand.value) if isinstance(operand, Const) else Unary(operand)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        operand = fold_expression(node.operand, filters)
        return Const(filters[node.name](operand.value)) if isinstance(operand, Const) else Filter(node.name, operand)
    if isinstance(node, Field):
        return Field(fold_expression(node.of, filters), fold_expression(node.name, filters))
    if not isinstance(node, Binary):
        return node
    left, right = fold_expression(node.left, filters), fold_expression(node.right, filters)
    if node.operator in ("and", "or"):
        if isinstance(left, Const):
            return right if bool(left.value) == (node.operator == "and") else left
    elif isinstance(left, Const) and isinstance(right, Const):
        operation = _OPERATIONS.get(node.operator, _add)
        return Const(operation(left.value, right.value))
    return Binary(node.operator, left, right)


def fold(body: tuple, filters: dict[str, Callable]) -> tuple:
    """``body`` with constants folded, dead branches gone and neighbouring texts joined."""
    found: list = []
    for node in body:
        if isinstance(node, Output):
            value = fold_expression(node.value, filters)
            if isinstance(value, Const):
                value = Const(shown(value.value))
                if not value.value:
                    continue
                if found and isinstance(found[-1], Output) and isinstance(found[-1].value, Const):
                    value = Const(found.pop().value.value + value.value)
            found.append(Output(value))
        elif isinstance(node, Set):
            found.append(Set(node.name, fold_expression(node.value, filters)))
        elif isinstance(node, For):
            found.append(For(node.name, fold_expression(node.over, filters), fold(node.body, filters)))
        elif isinstance(node, Generation):
            found.append(Generation(fold(node.body, filters)))
        else:
            branches = []
            for condition, inner in node.branches:
                condition = fold_expression(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold(inner, filters)))
                if isinstance(condition, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    texts = found and isinstance(found[-1], Output) and isinstance(found[-1].value, Const)
                    if texts and isinstance(inner, Output) and isinstance(inner.value, Const):
                        inner = Output(Const(found.pop().value.value + inner.value.value))
                    found.append(inner)
            elif branches:
                found.append(If(tuple(branches)))
    return tuple(found)


# -- closures ----------------------------------------------------------------------------------------


def _name(scope: Scope, name: str) -> object:
    if name not in scope:
        raise TemplateError(f"no such name: {name!r}")
    return scope[name]


def _field(of: object, name: object) -> object:
    # Only the fields of given mappings can be read, never attributes of objects.
    if not isinstance(of, dict) or name not in of:
        raise TemplateError(f"no such field: {name!r}")
    return of[name]


def value_of(node, filters: dict[str, Callable]) -> Callable[[Scope], object]:
    """A closure for an expression."""
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        return lambda scope: _name(scope, node.name)
    if isinstance(node, Field):
        of, name = value_of(node.of, filters), value_of(node.name, filters)
        return lambda scope: _field(of(scope), name(scope))
    if isinstance(node, Unary):
        operand = value_of(node.operand, filters)
        return lambda scope: not operand(scope)
    if isinstance(node, Filter):
        operand, function = value_of(node.operand, filters), filters[node.name]
        return lambda scope: function(operand(scope))
    left, right = value_of(node.left, filters), value_of(node.right, filters)
    if node.operator == "and":
        return lambda scope: left(scope) and right(scope)
    if node.operator == "or":
        return lambda scope: left(scope) or right(scope)
    operation = _OPERATIONS.get(node.operator, _add)
    return lambda scope: operation(left(scope), right(scope))


def _items(values: Iterable) -> Iterator[tuple[object, bool]]:
    """(item, it is the last one), looking one item ahead."""
    values = iter(values)
    for held in values:
        for following in values:
            yield held, False
            held = following
        yield held, True


Renderer = Callable[[Scope, bool], Pieces]


def _rendered(node, filters: dict[str, Callable]) -> Renderer:
    if isinstance(node, Output):
        value = value_of(node.value, filters)

        def output(scope: Scope, inside: bool) -> Pieces:
            yield shown(value(scope)), inside

        return output
    if isinstance(node, Set):
        value = value_of(node.value, filters)

        def assign(scope: Scope, inside: bool) -> Pieces:
            scope[node.name] = value(scope)
            yield from ()

        return assign
    if isinstance(node, Generation):
        body = _body(node.body, filters)
        return lambda scope, inside: body(scope, True)
    if isinstance(node, For):
        over, body = value_of(node.over, filters), _body(node.body, filters)

        def loop(scope: Scope, inside: bool) -> Pieces:
            inner = dict(scope)
            values = over(scope)
            if isinstance(values, (str, bytes, dict)) or not isinstance(values, Iterable):
                raise TemplateError("'for' takes a sequence")
            for k, (value, last) in enumerate(_items(values)):
                inner[node.name] = value
                inner["loop"] = {"index": k + 1, "first": k == 0, "last": last}
                yield from body(inner, inside)

        return loop
    branches = [(value_of(condition, filters), _body(body, filters)) for condition, body in node.branches]

    def choose(scope: Scope, inside: bool) -> Pieces:
        for condition, body in branches:
            if condition(scope):
                yield from body(scope, inside)
                return

    return choose


def _body(body: tuple, filters: dict[str, Callable]) -> Renderer:
    renderers = [_rendered(node, filters) for node in body]

    def run(scope: Scope, inside: bool) -> Pieces:
        for renderer in renderers:
            yield from renderer(scope, inside)

    return run


def compile_template(text: str, filters: dict[str, Callable] | None = None) -> Callable[[Scope], Pieces]:
    """A function from named inputs to the (text, inside a generation block) pieces of ``text``."""
    filters = filters or {}
    body = _body(fold(parse(text), filters), filters)
    return lambda scope: body(dict(scope), False)
