"""A sandboxed template language for chats, compiled to Python closures.

``{{ e }}`` puts a value, ``{% if e %} {% elif e %} {% else %} {% endif %}``, ``{% for x in e %} {% endfor %}``
and ``{% set x = e %}`` work as one expects, ``{% generation %} {% endgeneration %}`` marks what a model is to
learn to say, ``{# #}`` is a comment, and a hyphen inside a tag (``{%- -%}``) strips the white space beside it.
Expressions have strings, whole numbers, true, false, none, names, ``a.b``, ``a['b']``, ``a[0]``, comparisons,
``in``, ``and``, ``or``, ``not``, ``+`` and ``-`` of numbers, ``~`` (joins as text), ``a if c else b`` and
filters ``a | f``.

Sandbox: values are strings, numbers, lists and dicts; ``.b`` looks up a dict's key and never an attribute,
there are no calls but filters, which the host names, and names may not start with an underscore.

A template is parsed to a syntax tree (tuples, the kind first), constants are folded (operators on constants,
filters on constants, branches with constant tests, neighbouring texts), and what stays becomes closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

Node = tuple
#: What a closure writes to: pieces of text, and the marks of generations.
Out = list
OPEN, CLOSE = object(), object()


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len}
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)")
_CLOSER = {"{{": "}}", "{%": "%}", "{#": "#}"}
_WORD = re.compile(r"\s*(?:(\d+)|([A-Za-z][A-Za-z0-9_]*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+~|.<>()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "in", "if", "else"}


def _text(x) -> str:
    return "" if x is None else ("false", "true")[x] if isinstance(x, bool) else str(x)


def _pieces(source: str) -> list[tuple[str, str]]:
    """Texts, expressions and tags, with white space stripped where hyphens ask for it."""
    out, at, strip = [], 0, False
    while m := _TAG.search(source, at):
        kind = m[0][:2]
        end = _string_end(source, m.end(), _CLOSER[kind]) if kind != "{#" else source.find("#}", m.end())
        if end < 0:
            raise TemplateError(f"{m[0]} is not closed")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m[0].endswith("-") else text))
        strip = source[end - 1] == "-" and end > m.end()
        if kind != "{#":
            out.append(("put" if kind == "{{" else "tag", source[m.end() : end - strip]))
        at = end + 2
    text = source[at:]
    return [x for x in [*out, ("text", text.lstrip() if strip else text)] if x != ("text", "")]


def _string_end(source: str, at: int, closer: str) -> int:
    """Where ``closer`` stands outside of strings."""
    m = re.compile(r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|(?!" + re.escape(closer) + r").)*", re.S).match(source, at)
    return m.end() if source.startswith(closer, m.end()) else -1


class _Expression:
    """Recursive descent over the words of one expression."""

    def __init__(self, source: str):
        self.words, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at : at + 20]!r}")
            kind = m.lastindex
            self.words.append((("number", "name", "string", "sign")[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][1] in values and self.words[self.at][0] in ("name", "sign")

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at < len(self.words) and self.words[self.at][0] == "name" and self.words[self.at][1] not in _RESERVED:
            self.at += 1
            return self.words[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"too much: {self.words[self.at][1]!r}")

    def choice(self) -> Node:
        value = self.level(0)
        if self.take("if"):
            test = self.level(0)
            self.need("else")
            return ("choice", test, value, self.choice())
        return value

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"))

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.filtered()
        if k == 2:
            return ("not", self.level(2)) if self.take("not") else self.level(3)
        left = self.level(k + 1)
        while sign := self.take(*self.LEVELS[k]):
            left = ("binary", sign, left, self.level(k + 1))
        return left

    def filtered(self) -> Node:
        value = self.single()
        while self.take("|"):
            value = ("filter", self.name(), value)
        return value

    def single(self) -> Node:
        if self.take("("):
            value = self.choice()
            self.need(")")
        elif self.take("-"):
            return ("binary", "-", ("constant", 0), self.single())
        else:
            if self.at >= len(self.words):
                raise TemplateError("an expression ends too soon")
            kind, word = self.words[self.at]
            if kind == "number":
                value = ("constant", int(word))
                self.at += 1
            elif kind == "string":
                value = ("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
                self.at += 1
            else:
                word = self.name()
                value = ("constant", _CONSTANTS[word]) if word in _CONSTANTS else ("name", word)
        while True:
            if self.take("."):
                value = ("item", value, ("constant", self.name()))
            elif self.take("["):
                value = ("item", value, self.choice())
                self.need("]")
            else:
                return value


def parse(source: str) -> list[Node]:
    """The syntax tree: a list of ("text", s), ("put", e), ("if", [(test, body)], otherwise), ("for", name, e, body), ("set", name, e), ("generation", body)."""
    pieces = _pieces(source)
    body, at, ended = _body(pieces, 0, ())
    assert ended is None and at == len(pieces)
    return body


def _expression(source: str) -> Node:
    e = _Expression(source)
    value = e.choice()
    e.end()
    return value


def _body(pieces: list, at: int, until: tuple[str, ...]) -> tuple[list[Node], int, str | None]:
    """Nodes up to one of the tags ``until``, the place after it, and that tag."""
    out: list[Node] = []
    while at < len(pieces):
        kind, source = pieces[at]
        at += 1
        if kind == "text":
            out.append(("text", source))
        elif kind == "put":
            out.append(("put", _expression(source)))
        else:
            word, _, rest = source.strip().partition(" ")
            if word in until:
                return out, at, source.strip()
            if word == "if":
                branches, otherwise, tag = [], [], "if " + rest
                while tag != "endif":
                    if tag == "else":
                        otherwise, at, tag = _body(pieces, at, ("endif",))
                    else:
                        test = _expression(tag.partition(" ")[2])
                        body, at, tag = _body(pieces, at, ("elif", "else", "endif"))
                        branches.append((test, body))
                out.append(("if", branches, otherwise))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                over = e.choice()
                e.end()
                body, at, _ = _body(pieces, at, ("endfor",))
                out.append(("for", name, over, body))
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                value = e.choice()
                e.end()
                out.append(("set", name, value))
            elif word == "generation":
                body, at, _ = _body(pieces, at, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"unknown tag {word!r}")
    if until:
        raise TemplateError(f"{' or '.join(until)} is missing")
    return out, at, None


def _add(a, b, by: int):
    if type(a) is not int or type(b) is not int:
        raise TemplateError("only whole numbers can be added; text is joined by ~")
    return a + by * b


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: _add(a, b, 1), "-": lambda a, b: _add(a, b, -1),
}


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """An expression with its constant parts computed."""
    kind = node[0]
    known = lambda *n: all(x[0] == "constant" for x in n)
    sub = lambda n: fold(n, filters)
    if kind == "binary":
        _, sign, a, b = node
        a, b = sub(a), sub(b)
        if sign in ("and", "or"):
            if known(a):
                return b if bool(a[1]) == (sign == "and") else a
        elif known(a, b):
            return ("constant", _BINARY[sign](a[1], b[1]))
        return ("binary", sign, a, b)
    if kind == "not":
        a = sub(node[1])
        return ("constant", not a[1]) if known(a) else ("not", a)
    if kind == "choice":
        test, a, b = map(sub, node[1:])
        return (a if test[1] else b) if known(test) else ("choice", test, a, b)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        a = sub(node[2])
        return ("constant", filters[node[1]](a[1])) if known(a) else ("filter", node[1], a)
    if kind == "item":
        return ("item", sub(node[1]), sub(node[2]))
    return node


def fold_body(body: list[Node], filters: dict[str, Callable]) -> list[Node]:
    """Statements with constants folded: dead branches go, neighbouring texts become one."""
    out: list[Node] = []

    def add(n: Node) -> None:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        elif n != ("text", ""):
            out.append(n)

    for n in body:
        if n[0] == "put":
            e = fold(n[1], filters)
            add(("text", _text(e[1])) if e[0] == "constant" else ("put", e))
        elif n[0] == "if":
            branches, otherwise = [], fold_body(n[2], filters)
            for test, inner in n[1]:
                test, inner = fold(test, filters), fold_body(inner, filters)
                if test[0] == "constant" and not test[1]:
                    continue
                if test[0] == "constant":
                    otherwise = inner
                    break
                branches.append((test, inner))
            for x in [("if", branches, otherwise)] if branches else otherwise:
                add(x)
        elif n[0] == "for":
            add(("for", n[1], fold(n[2], filters), fold_body(n[3], filters)))
        elif n[0] == "set":
            add(("set", n[1], fold(n[2], filters)))
        elif n[0] == "generation":
            add(("generation", fold_body(n[1], filters)))
        else:
            add(n)
    return out


def _item(a, b):
    if isinstance(a, dict) and isinstance(b, str):
        return a.get(b)
    if isinstance(a, list) and type(b) is int:
        return a[b] if -len(a) <= b < len(a) else None
    raise TemplateError(f"no item {b!r} in a value of kind {type(a).__name__}")


def evaluator(node: Node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """The closure of a folded expression: names → value. A name that isn't set is none."""
    kind = node[0]
    if kind == "constant":
        value = node[1]
        return lambda names: value
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "not":
        a = evaluator(node[1], filters)
        return lambda names: not a(names)
    if kind == "filter":
        f, a = filters[node[1]], evaluator(node[2], filters)
        return lambda names: f(a(names))
    if kind == "choice":
        test, a, b = (evaluator(x, filters) for x in node[1:])
        return lambda names: a(names) if test(names) else b(names)
    if kind == "item":
        a, b = (evaluator(x, filters) for x in node[1:])
        return lambda names: _item(a(names), b(names))
    a, b = (evaluator(x, filters) for x in node[2:])
    if node[1] == "and":
        return lambda names: a(names) and b(names)
    if node[1] == "or":
        return lambda names: a(names) or b(names)
    f = _BINARY[node[1]]
    return lambda names: f(a(names), b(names))


def writer(body: list[Node], filters: dict[str, Callable]) -> Callable[[dict, Out], None]:
    """The closure of folded statements: appends to ``out`` the pieces that they put."""
    return reduce(lambda f, g: lambda names, out: (f(names, out), g(names, out))[0], [_statement(n, filters) for n in body], lambda names, out: None)


def _statement(n: Node, filters: dict[str, Callable]) -> Callable[[dict, Out], None]:
    kind = n[0]
    if kind == "text":
        text = n[1]
        return lambda names, out: out.append(text)
    if kind == "put":
        e = evaluator(n[1], filters)
        return lambda names, out: out.append(_text(e(names)))
    if kind == "set":
        name, value = n[1], evaluator(n[2], filters)
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "generation":
        inner = writer(n[1], filters)

        def generation(names: dict, out: Out) -> None:
            out.append(OPEN)
            inner(names, out)
            out.append(CLOSE)

        return generation
    if kind == "if":
        branches, otherwise = [(evaluator(t, filters), writer(b, filters)) for t, b in n[1]], writer(n[2], filters)

        def choose(names: dict, out: Out) -> None:
            for test, then in branches:
                if test(names):
                    return then(names, out)
            return otherwise(names, out)

        return choose
    name, over, inner = n[1], evaluator(n[2], filters), writer(n[3], filters)

    def loop(names: dict, out: Out) -> None:
        items = over(names)
        if not isinstance(items, list):
            raise TemplateError("for needs a list")
        for i, x in enumerate(items):
            inner({**names, name: x, "loop": _loop(i, i == len(items) - 1)}, out)

    return loop


def _loop(i: int, last: bool) -> dict:
    return {"index0": i, "index": i + 1, "first": i == 0, "last": last}


def joined(out: Out) -> tuple[str, list[tuple[int, int]]]:
    """The text of written pieces and the spans (code points, end excluded) of its generations; empty ones don't count."""
    texts, spans, at, start, depth = [], [], 0, 0, 0
    for x in out:
        if x is OPEN:
            start = at if depth == 0 else start
            depth += 1
        elif x is CLOSE:
            depth -= 1
            if depth == 0 and at > start:
                spans.append((start, at))
        else:
            texts.append(x)
            at += len(x)
    return "".join(texts), spans


def _names(node) -> set[str]:
    """All names that a tree reads."""
    if isinstance(node, tuple) and len(node) == 2 and node[0] == "name":
        return {node[1]}
    return set().union(*map(_names, node)) if isinstance(node, tuple | list) else set()


class Template:
    """A compiled template: ``render`` for a whole conversation, ``begin``, ``turn`` and ``finish`` for one that comes turn by turn.

    The latter need a template that reads ``messages`` in one loop only, at its top level; ``streams`` tells.
    What lies before the loop may set names, which the turns see; a turn sees nothing of those before it.
    """

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        filters = FILTERS | (filters or {})
        self.tree = fold_body(parse(source), filters)
        self._all = writer(self.tree, filters)
        loops = [i for i, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        rest = [n if i not in loops else n[3] for i, n in enumerate(self.tree)]
        self.streams = len(loops) == 1 and "messages" not in _names(rest)
        if self.streams:
            at = loops[0]
            self._name = self.tree[at][1]
            self._before, self._turn, self._after = (writer(b, filters) for b in (self.tree[:at], self.tree[at][3], self.tree[at + 1 :]))

    def render(self, messages: list[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        out: Out = []
        self._all({**names, "messages": messages}, out)
        return joined(out)

    def begin(self, names: dict, out: Out) -> dict:
        names = dict(names)
        self._before(names, out)
        return names

    def turn(self, names: dict, message: dict, index: int, last: bool, out: Out) -> None:
        self._turn({**names, self._name: message, "loop": _loop(index, last)}, out)

    def finish(self, names: dict, out: Out) -> None:
        self._after(dict(names), out)
