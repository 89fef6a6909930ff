"""A small predicate language over records, compiled to Spark columns.

    (size > 20) & (type != b'ECONOMY')

Tokens become a tree by precedence climbing, with the precedence of Python (so ``&`` binds tighter than
``==``, and comparisons chain), and the tree becomes a Column. No text is evaluated, and none is put into SQL.
Names may hold digits and ``_``; ``b'..'`` and ``'..'`` are the same string; ``and``, ``or``, ``not``
work as ``&``, ``|``, ``~``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidQuery(ValueError):
    """A query that cannot be compiled."""


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<string>b?(?P<quote>['"])(?P<body>.*?)(?P=quote))
    | (?P<open>b?['"])
    | (?P<name>[^\W\d]\w*)
    | (?P<op>\*\*|<<|>>|==|!=|<=|>=|[-+*/%<>&|^~()=])
    )""",
    re.VERBOSE | re.DOTALL,
)
#: Names that no field may have. (Fixed values.)
REFUSED = {"import"}


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any


def tokens(query: str) -> list[Token]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        found = _TOKEN.match(query, at)
        if not found:
            raise InvalidQuery(f"unexpected {query[at:].strip()[:1]!r}")
        at = found.end()
        if found["open"]:
            raise InvalidQuery("no matching quote character")
        if found["number"]:
            text = found["number"]
            out.append(Token("number", int(text) if text.isdigit() else float(text)))
        elif found["string"]:
            out.append(Token("string", found["body"]))
        elif found["name"]:
            word = found["name"]
            out.append(Token("op", {"and": "&&", "or": "||", "not": "!"}[word]) if word in ("and", "or", "not") else Token("name", word))
        else:
            out.append(Token("op", "==" if found["op"] == "=" else found["op"]))
    return out


#: Binary operators by the strength with which they bind. (Fixed values.)
BINDING = {"||": 1, "&&": 2, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 12}
COMPARE, COMPARE_BINDING = {"==", "!=", "<", "<=", ">", ">="}, 4


class _Parser:
    def __init__(self, found: list[Token], fields: Mapping[str, Any] | list[str]):
        self.found, self.at, self.fields, self.used = found, 0, set(fields), 0
        if REFUSED & self.fields:
            raise InvalidQuery("invalid field name")

    def peek(self) -> str | None:
        token = self.found[self.at] if self.at < len(self.found) else None
        return token.value if token and token.kind == "op" else None

    def next(self) -> Token:
        if self.at >= len(self.found):
            raise InvalidQuery("the query ends too early")
        self.at += 1
        return self.found[self.at - 1]

    def expression(self, least: int = 0) -> tuple:
        left = self.unary()
        while (op := self.peek()) is not None:
            if op in COMPARE:
                if least > COMPARE_BINDING:
                    break
                chain = [left]
                while (op := self.peek()) in COMPARE:
                    self.next()
                    chain += [op, self.expression(COMPARE_BINDING + 1)]
                left = ("compare", *chain)
            elif op in BINDING and BINDING[op] >= least:
                self.next()
                left = ("binary", op, left, self.expression(BINDING[op] + (op != "**")))
            else:
                break
        return left

    def unary(self) -> tuple:
        token = self.next()
        if token.kind == "op":
            if token.value == "(":
                inner = self.expression()
                if self.at >= len(self.found) or self.next().value != ")":
                    raise InvalidQuery("mismatched parenthesis")
                return inner
            if token.value in ("-", "+", "~"):
                return ("unary", token.value, self.expression(11))
            if token.value == "!":
                return ("unary", "!", self.expression(3))
            raise InvalidQuery("mismatched parenthesis" if token.value == ")" else f"unexpected {token.value!r}")
        if token.kind == "name":
            if token.value not in self.fields:
                raise InvalidQuery(f"unknown field name {token.value!r}")
            self.used += 1
            return ("field", token.value)
        return (token.kind, token.value)


def parse(query: str, fields: Mapping[str, Any] | list[str]) -> tuple:
    """The tree of a query over fields of these names."""
    parser = _Parser(tokens(query), fields)
    tree = parser.expression()
    if parser.at < len(parser.found):
        left = parser.found[parser.at].value
        raise InvalidQuery("mismatched parenthesis" if left in ("(", ")") else f"unexpected {left!r}")
    if not parser.used:
        raise InvalidQuery("no field value")
    return tree


_LOGIC = {"compare", "not"}


def _is_condition(tree: tuple) -> bool:
    kind = tree[0]
    return kind == "compare" or (kind == "binary" and tree[1] in ("&&", "||")) or (kind == "binary" and tree[1] in ("&", "|", "^") and _is_condition(tree[2])) or (kind == "unary" and tree[1] in ("!", "~") and _is_condition(tree[2]))


_COMPARED = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_COMPUTED = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a.cast("double") / b,
    "%": lambda a, b: F.pmod(a, b),
    "**": F.pow,
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
    "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}


def column(tree: tuple, fields: Mapping[str, Column]) -> Column:
    """The Column of a tree."""
    kind = tree[0]
    if kind == "field":
        return fields[tree[1]]
    if kind in ("number", "string"):
        return F.lit(tree[1])
    if kind == "compare":
        terms = [column(x, fields) for x in tree[1::2]]
        out = None
        for k, op in enumerate(tree[2::2]):
            one = _COMPARED[op](terms[k], terms[k + 1])
            out = one if out is None else out & one
        return out
    if kind == "unary":
        inner = column(tree[2], fields)
        if tree[1] == "!" or (tree[1] == "~" and _is_condition(tree[2])):
            return ~inner
        return {"-": lambda x: -x, "+": lambda x: x, "~": F.bitwise_not}[tree[1]](inner)
    op, left, right = tree[1], column(tree[2], fields), column(tree[3], fields)
    if op in ("&&", "||") or (op in ("&", "|", "^") and _is_condition(tree[2]) and _is_condition(tree[3])):
        return left & right if op in ("&", "&&") else left | right if op in ("|", "||") else left != right
    return _COMPUTED[op](left, right)


def compile_query(query: str, fields: Mapping[str, Column] | list[str]) -> Column:
    """A query as a Column over fields, given as columns or by name."""
    columns = fields if isinstance(fields, Mapping) else {x: F.col(f"`{x}`") for x in fields}
    tree = parse(query, columns)
    if not _is_condition(tree):
        raise InvalidQuery("the query is no condition")
    return column(tree, columns)
