"""Compiler of a small sandboxed template language for conversations.

``compile_template`` reads the source into a syntax tree, folds constants and turns the tree into nested Python closures; the
result renders a dictionary of values into text and lists the spans that ``{% generation %}`` blocks wrote.

    {{ expression }}   {# comment #}   {%- statement -%}   (a dash trims the blanks outside)
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% for name in list if test %} {% else %} {% endfor %}   with loop.index, index0, first, last, length
    {% set name = expression %}   {% generation %} {% endgeneration %}

Expressions have strings, numbers, true, false, none, lists, names, ``a.b`` and ``a[b]`` on dictionaries and lists,
``| filter(arguments)``, ``is [not] defined / none``, ``+ - * / // % ~``, comparisons with ``in``, ``not and or`` and
``a if test else b``.

The sandbox: values are data (text, numbers, lists, dictionaries); a template reaches no attribute of a Python object, no name
that begins with an underscore, and calls nothing but filters and ``raise_exception``; there are no open loops, products are of
numbers only, blocks nest ``DEPTH`` deep at most, and a rendering beyond ``limit`` characters raises.  Faults of a template
raise ``TemplateError`` and never cut a text short.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

DEPTH = 60
LIMIT = 1 << 30


class TemplateError(ValueError):
    """The template does not follow the language, or its values do not fit it."""


class _Missing:
    """Value of a name or key that is not there: false, and nothing when written."""

    def __bool__(self):
        return False

    def __str__(self):
        return ""


MISSING = _Missing()


# Syntax tree: expressions.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Many:
    items: tuple


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator, test, filter or function of evaluated arguments."""

    kind: str
    name: str
    args: tuple


@dataclass(frozen=True)
class Either:
    """``and`` / ``or``: the second side is evaluated only where the first does not settle it."""

    settles: bool
    a: object
    b: object


@dataclass(frozen=True)
class Choice:
    test: object
    then: object
    other: object


# Syntax tree: statements.
@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: object
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def _written(value: object) -> str:
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return {None: "none", True: "true", False: "false"}[value]
    if isinstance(value, (int, float, _Missing)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be written as text")


def _numbers(*values: object) -> None:
    if not all(isinstance(v, (int, float)) for v in values):
        raise TemplateError("this operator takes numbers")


def _add(a, b):
    if not (isinstance(a, str) and isinstance(b, str)):
        _numbers(a, b)
    return a + b


def _arithmetic(fn):
    def apply(a, b):
        _numbers(a, b)
        return fn(a, b)

    return apply


def _within(a, b):
    if not isinstance(b, (str, list, tuple, Mapping)) or (isinstance(b, str) and not isinstance(a, str)):
        raise TemplateError("'in' takes a text in a text, or anything in a list or dictionary")
    return a in b


def _refuse(message):
    raise TemplateError(_written(message))


OPERATORS: dict[str, Callable] = {
    "+": _add, "-": _arithmetic(operator.sub), "*": _arithmetic(operator.mul), "/": _arithmetic(operator.truediv), "//": _arithmetic(operator.floordiv),
    "%": _arithmetic(operator.mod), "~": lambda a, b: _written(a) + _written(b), "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le,
    ">": operator.gt, ">=": operator.ge, "in": _within, "not in": lambda a, b: not _within(a, b), "not": operator.not_, "neg": lambda a: 0 - a,
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: v is not MISSING, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _written(v).strip(), "upper": lambda v: _written(v).upper(), "lower": lambda v: _written(v).lower(), "length": len,
    "default": lambda v, other="": other if v is MISSING else v, "replace": lambda v, a, b: _written(v).replace(a, b),
    "join": lambda v, by="": by.join(map(_written, v)), "first": lambda v: v[0] if v else MISSING, "last": lambda v: v[-1] if v else MISSING,
    "tojson": lambda v: json.dumps(v, ensure_ascii=False), "string": _written,
}
FUNCTIONS: dict[str, Callable] = {"raise_exception": _refuse}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "elif", "for", *_CONSTANTS}
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*/%~<>=|.,()\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_TAG = re.compile(r"\{([{%#])(-?)")


def _lex(source: str) -> list[tuple[str, object]]:
    tokens, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at : at + 20]!r}")
        at, kind, text = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "number":
            tokens.append((kind, float(text) if "." in text else int(text)))
        elif kind == "string":
            tokens.append((kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        else:
            if text.startswith("_"):
                raise TemplateError(f"the name {text} is not allowed")
            tokens.append(("word" if text in _WORDS else kind, text))
    return tokens


class _Expression:
    """Reads one tag's tokens by descent, from the loosest operator to the tightest."""

    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "/", "//", "%"))

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters, self.depth = _lex(source), 0, filters, 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in {"word", "sign"} and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> bool:
        if self.peek(*wanted):
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is not expected")

    def whole(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("the expression is too deep")
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = Choice(test, value, self.whole() if self.take("else") else Const(MISSING))
        self.depth -= 1
        return value

    def either(self, settles: bool = True):
        """``or`` over ``and`` over ``not``."""
        below = (lambda: self.either(False)) if settles else self.negated
        value = below()
        while self.take("or" if settles else "and"):
            value = Either(settles, value, below())
        return value

    def negated(self):
        flips = 0
        while self.take("not"):
            flips += 1
        value = self.binary(0)
        for _ in range(min(flips, 2 + flips % 2)):
            value = Apply("operator", "not", (value,))
        return value

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        value = self.binary(level + 1)
        while True:
            if level == 0 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                value = Apply("operator", "not in", (value, self.binary(1)))
            elif self.peek(*self.LEVELS[level]):
                self.at += 1
                value = Apply("operator", self.tokens[self.at - 1][1], (value, self.binary(level + 1)))
            elif level == 0 and self.take("is"):
                flip = self.take("not")
                kind, test = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if test not in TESTS:
                    raise TemplateError(f"no test is named {test!r}")
                self.at += 1
                value = Apply("test", test, (value,))
                value = Apply("operator", "not", (value,)) if flip else value
            else:
                return value

    def unary(self):
        if self.take("-"):
            return Apply("operator", "neg", (self.postfix(),))
        return self.postfix()

    def arguments(self) -> tuple:
        args = []
        while not self.take(")"):
            args.append(self.whole())
            if not self.peek(")"):
                self.need(",")
        return tuple(args)

    def postfix(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.whole())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter is named {name!r}")
                value = Apply("filter", name, (value, *(self.arguments() if self.take("(") else ())))
            else:
                return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind in {"number", "string"}:
            return Const(text)
        if kind == "name":
            if not self.take("("):
                return Name(text)
            if text not in FUNCTIONS:
                raise TemplateError(f"no function is named {text!r}")
            return Apply("function", text, self.arguments())
        if kind == "word" and text in _CONSTANTS:
            return Const(_CONSTANTS[text])
        if text == "(":
            value = self.whole()
            self.need(")")
            return value
        if text == "[":
            items = []
            while not self.take("]"):
                items.append(self.whole())
                if not self.peek("]"):
                    self.need(",")
            return Many(tuple(items))
        raise TemplateError(f"{text!r} is not expected")


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): kinds are text, { for expressions and % for statements; dashes are applied, comments dropped."""
    pieces, at, trim = [], 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        if m and m[2]:
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if not m:
            return pieces
        closing = {"{": "}}", "%": "%}", "#": "#}"}[m[1]]
        inside = re.compile(r"(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|(?!%s).)*?(?=-?%s)" % (closing, closing), re.S) if m[1] != "#" else re.compile(r".*?(?=-?#\})", re.S)
        body = inside.match(source, m.end())
        if not body:
            raise TemplateError(f"a tag is not closed: {source[m.start() : m.start() + 20]!r}")
        trim = source.startswith("-", body.end())
        at = body.end() + trim + 2
        if m[1] != "#":
            pieces.append((m[1], body[0]))


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """Syntax tree of a template."""
    pieces = _pieces(source)
    at = 0

    def block(ends: tuple[str, ...], depth: int, marked: bool) -> tuple[tuple, str, _Expression | None]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("blocks are nested too deep")
        body = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                body.append(Text(content))
                continue
            reader = _Expression(content, filters)
            if kind == "{":
                body.append(Emit(reader.whole()))
                reader.end()
                continue
            word = str(reader.tokens[0][1]) if reader.tokens else ""
            reader.at = 1
            if word in ends:
                return tuple(body), word, reader
            if word == "if":
                body.append(condition(reader, depth, marked))
            elif word == "for":
                name = reader.name()
                reader.need("in")
                of = reader.either()
                test = reader.whole() if reader.take("if") else None
                reader.end()
                inner, stop, _ = block(("endfor", "else"), depth + 1, marked)
                other = block(("endfor",), depth + 1, marked)[0] if stop == "else" else ()
                body.append(For(name, of, test, inner, other))
            elif word == "set":
                name = reader.name()
                reader.need("=")
                body.append(Set(name, reader.whole()))
                reader.end()
            elif word == "generation":
                if marked:
                    raise TemplateError("generation blocks do not nest")
                reader.end()
                body.append(Generation(block(("endgeneration",), depth + 1, True)[0]))
            else:
                raise TemplateError(f"no statement is named {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return tuple(body), "", None

    def condition(reader: _Expression, depth: int, marked: bool) -> If:
        test = reader.whole()
        reader.end()
        then, stop, more = block(("endif", "else", "elif"), depth + 1, marked)
        other: tuple = ()
        if stop == "elif":
            other = (condition(more, depth + 1, marked),)
        elif stop == "else":
            other = block(("endif",), depth + 1, marked)[0]
        return If(test, then, other)

    return block((), 0, False)[0]


def _library(kind: str, filters: Mapping[str, Callable]) -> Mapping[str, Callable]:
    return {"operator": OPERATORS, "test": TESTS, "filter": filters, "function": FUNCTIONS}[kind]


def _call(fn: Callable, args: tuple):
    try:
        return fn(*args)
    except TemplateError:
        raise
    except (TypeError, ArithmeticError, AttributeError, LookupError) as fault:
        raise TemplateError(str(fault)) from fault


def _item(of, key):
    if isinstance(of, Mapping):
        return of.get(key, MISSING)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else MISSING
    raise TemplateError(f"{key!r} is not a part of a {type(of).__name__}")


def fold(node, filters: Mapping[str, Callable] = FILTERS):
    """The tree with constant parts evaluated, untaken branches dropped and neighbouring texts joined.

    What would raise stays, so that it raises only where it is reached.
    """
    def sub(x):
        return fold(x, filters)

    def constant(args: tuple) -> bool:
        return all(isinstance(a, Const) for a in args)

    if isinstance(node, tuple):
        out: list = []
        for s in node:
            done = sub(s)
            for piece in done if isinstance(done, tuple) else (done,):
                if isinstance(piece, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + piece.value)
                elif piece != Text(""):
                    out.append(piece)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(sub, node.args))
        if constant(args) and node.kind != "function":
            try:
                return Const(_call(_library(node.kind, filters)[node.name], tuple(a.value for a in args)))
            except TemplateError:
                pass
        return Apply(node.kind, node.name, args)
    if isinstance(node, Many):
        items = tuple(map(sub, node.items))
        return Const([i.value for i in items]) if constant(items) else Many(items)
    if isinstance(node, Item):
        of, key = sub(node.of), sub(node.key)
        if constant((of, key)):
            try:
                return Const(_item(of.value, key.value))
            except TemplateError:
                pass
        return Item(of, key)
    if isinstance(node, Either):
        a, b = sub(node.a), sub(node.b)
        if isinstance(a, Const):
            return a if bool(a.value) is node.settles else b
        return Either(node.settles, a, b)
    if isinstance(node, Choice):
        test = sub(node.test)
        if isinstance(test, Const):
            return sub(node.then if test.value else node.other)
        return Choice(test, sub(node.then), sub(node.other))
    if isinstance(node, Emit):
        value = sub(node.value)
        if isinstance(value, Const):
            try:
                return Text(_written(value.value))
            except TemplateError:
                pass
        return Emit(value)
    if isinstance(node, If):
        test = sub(node.test)
        if isinstance(test, Const) and not _sets(node.then if test.value else node.other):
            return sub(node.then if test.value else node.other)
        return If(test, sub(node.then), sub(node.other))
    if isinstance(node, For):
        of, other = sub(node.of), sub(node.other)
        if isinstance(of, Const) and of.value in ([], (), MISSING) and not _sets(other):
            return other
        return For(node.name, of, None if node.test is None else sub(node.test), sub(node.body), other)
    if isinstance(node, Set):
        return Set(node.name, sub(node.value))
    if isinstance(node, Generation):
        body = sub(node.body)
        return Generation(body) if body else ()
    return node


def _sets(body: tuple) -> bool:
    return any(isinstance(s, Set) for s in body)


class _Out:
    """Text pieces, their length so far and the spans of generation blocks."""

    def __init__(self, limit: int):
        self.pieces, self.length, self.spans, self.limit = [], 0, [], limit

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)
        if self.length > self.limit:
            raise TemplateError(f"the text is longer than {self.limit} characters")


class _Generator:
    """Closures over a frame (a list of values); names get their places in the frame when the closures are made."""

    def __init__(self, filters: Mapping[str, Callable]):
        self.filters, self.inputs, self.size = filters, {}, 0

    def place(self) -> int:
        self.size += 1
        return self.size - 1

    def expression(self, node, names: dict[str, int]) -> Callable:
        if isinstance(node, Const):
            value = node.value
            return lambda frame: value
        if isinstance(node, Name):
            at = names.get(node.name)
            if at is None:
                at = self.inputs.get(node.name)
            if at is None:
                at = self.inputs[node.name] = self.place()
            return lambda frame: frame[at]
        if isinstance(node, Many):
            items = [self.expression(i, names) for i in node.items]
            return lambda frame: [i(frame) for i in items]
        if isinstance(node, Item):
            of, key = self.expression(node.of, names), self.expression(node.key, names)
            return lambda frame: _item(of(frame), key(frame))
        if isinstance(node, Either):
            a, b, settles = self.expression(node.a, names), self.expression(node.b, names), node.settles

            def either(frame):
                first = a(frame)
                return first if bool(first) is settles else b(frame)

            return either
        if isinstance(node, Choice):
            test, then, other = (self.expression(x, names) for x in (node.test, node.then, node.other))
            return lambda frame: then(frame) if test(frame) else other(frame)
        fn = _library(node.kind, self.filters)[node.name]
        args = [self.expression(a, names) for a in node.args]
        if len(args) == 1:
            (only,) = args
            return lambda frame: _call(fn, (only(frame),))
        return lambda frame: _call(fn, tuple(a(frame) for a in args))

    def body(self, nodes: tuple, names: dict[str, int]) -> Callable:
        steps = [self.statement(n, names) for n in nodes]
        if len(steps) == 1:
            return steps[0]

        def run(frame, out):
            for step in steps:
                step(frame, out)

        return run

    def statement(self, node, names: dict[str, int]) -> Callable:
        if isinstance(node, Text):
            text = node.value
            return lambda frame, out: out.write(text)
        if isinstance(node, Emit):
            value = self.expression(node.value, names)
            return lambda frame, out: out.write(_written(value(frame)))
        if isinstance(node, If):
            test, then, other = self.expression(node.test, names), self.body(node.then, names), self.body(node.other, names)
            return lambda frame, out: (then if test(frame) else other)(frame, out)
        if isinstance(node, Set):
            value = self.expression(node.value, names)
            at = names.setdefault(node.name, self.place())

            def assign(frame, out):
                frame[at] = value(frame)

            return assign
        if isinstance(node, Generation):
            body = self.body(node.body, names)

            def mark(frame, out):
                start = out.length
                body(frame, out)
                if out.length > start:
                    out.spans.append((start, out.length))

            return mark
        return self.loop(node, names)

    def loop(self, node: For, names: dict[str, int]) -> Callable:
        of, other = self.expression(node.of, names), self.body(node.other, dict(names))
        own = {**names, node.name: self.place(), "loop": self.place()}
        at, state = own[node.name], own["loop"]
        kept = None if node.test is None else self.expression(node.test, own)
        # Names set inside a loop live in it: they are gone in the next turn, and outer ones are not changed.
        inside = _Scoped(own)
        body = self.body(node.body, inside)
        fresh = inside.added

        def run(frame, out):
            items = of(frame)
            if not isinstance(items, (list, tuple)):
                raise TemplateError(f"a loop over a {type(items).__name__}")
            if kept is not None:
                chosen = []
                for item in items:
                    frame[at] = item
                    if kept(frame):
                        chosen.append(item)
                items = chosen
            count = len(items)
            for i, item in enumerate(items):
                frame[at] = item
                frame[state] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == count - 1, "length": count}
                for place, source in fresh:
                    frame[place] = MISSING if source is None else frame[source]
                body(frame, out)
            if not count:
                other(frame, out)

        return run


class _Scoped(dict):
    """Names of a loop's body.  The first ``set`` of a name gives it a place of its own, which starts with the outer value."""

    def __init__(self, outer: dict[str, int]):
        super().__init__(outer)
        self.added: list[tuple[int, int | None]] = []
        self.mine: set[str] = set()

    def setdefault(self, name: str, place: int) -> int:
        if name not in self.mine:
            self.added.append((place, self.get(name)))
            self.mine.add(name)
            self[name] = place
        return self[name]


def compile_template(source: str, filters: Mapping[str, Callable] | None = None, limit: int = LIMIT) -> Callable[[Mapping], tuple[str, list[tuple[int, int]]]]:
    """Function from values to (text, spans of generation blocks: start, end in characters).  ``filters`` come beside the built-in ones."""
    every = {**FILTERS, **(filters or {})}
    tree = fold(parse(source, every), every)
    made = _Generator(every)
    body = made.body(tree, {})
    inputs, size = tuple(made.inputs.items()), made.size

    def render(values: Mapping) -> tuple[str, list[tuple[int, int]]]:
        frame: list = [MISSING] * size
        for name, at in inputs:
            frame[at] = values.get(name, MISSING)
        out = _Out(limit)
        body(frame, out)
        return "".join(out.pieces), out.spans

    return render
