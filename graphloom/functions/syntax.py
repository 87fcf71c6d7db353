"""Syntax trees of JSON texts and queries over them by S-expression patterns.

A pattern is ``(type child ...) @name``: a node of that type (``_`` is any) whose children match the
child patterns in order, others between allowed; ``field: (type)`` asks for a key or value of a
pair. Positions count bytes of UTF-8; points are row and column.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made_by

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(rb"""[ \t\r\n]*(?:(?P<mark>[\[\]{},:])|(?P<string>"(?:[^"\\\x00-\x1f]|\\.)*+")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<word>true|false|null))""")
_CONTENT = re.compile(rb"(?P<escape_sequence>\\(?:u[0-9a-fA-F]{4}|[^u]))|(?P<string_content>[^\\]+)")
_PATTERN = re.compile(r"\s*(?:(?P<mark>[()])|@(?P<capture>[\w.-]+)|(?P<field>\w+):|(?P<type>\w+))")


@dataclass
class Node:
    type: str
    start: int
    end: int = -1
    field: str | None = None
    children: list[Node] = made_by(default_factory=list)


@dataclass
class Pattern:
    type: str
    field: str | None
    capture: str | None = None
    children: list[Pattern] = made_by(default_factory=list)


class SyntaxProblem(ValueError):
    """A text or a pattern that can't be read."""


def parse(source: bytes) -> Node:
    """The tree of a JSON text (an empty one has no value). Nesting is kept on a list, so its depth has no limit."""
    root = Node("document", 0, len(source))
    open_nodes, expects, at, end = [root], "value", 0, len(source.rstrip(b" \t\r\n"))
    while at < end:
        token = _TOKEN.match(source, at)
        if token is None:
            raise SyntaxProblem(f"unexpected text at byte {at}")
        at, parent = token.end(), open_nodes[-1]
        mark = (token["mark"] or b"").decode()
        if mark == ":" and expects == "colon":
            expects = "value"
        elif mark == "," and expects == "more":
            expects = "key" if parent.type == "object" else "value"
        elif mark in ("}", "]") and expects in ("more", "first") and parent.type == {"}": "object", "]": "array"}[mark]:
            parent.end = at
            open_nodes.pop()
            expects = _after(open_nodes, at)
        elif mark in ("{", "[") and (expects == "value" or (expects == "first" and parent.type == "array")):
            node = Node("object" if mark == "{" else "array", at - 1, field="value" if parent.type == "pair" else None)
            parent.children.append(node)
            open_nodes.append(node)
            expects = "first"
        elif not mark and (key := parent.type == "object" and expects in ("first", "key")) and token["string"]:
            pair = Node("pair", token.start("string"))
            pair.children.append(_string(source, token, "key"))
            parent.children.append(pair)
            open_nodes.append(pair)
            expects = "colon"
        elif not mark and not key and expects in ("value", "first"):
            of = "value" if parent.type == "pair" else None
            start = token.start(token.lastgroup)
            node = _string(source, token, of) if token["string"] else Node("number" if token["number"] else token["word"].decode(), start, at, of)
            parent.children.append(node)
            expects = _after(open_nodes, at)
        else:
            raise SyntaxProblem(f"unexpected token at byte {token.start(token.lastgroup)}")
    if len(open_nodes) > 1:
        raise SyntaxProblem("the text ends too early")
    return root


def _after(open_nodes: list[Node], at: int) -> str:
    """What may follow a value; a pair ends with its value."""
    if open_nodes[-1].type == "pair":
        open_nodes.pop().end = at
    return "more" if len(open_nodes) > 1 else "end"


def _string(source: bytes, token: re.Match, of: str | None) -> Node:
    start, end = token.span("string")
    node = Node("string", start, end, of)
    node.children = [Node(part.lastgroup, part.start(), part.end()) for part in _CONTENT.finditer(source, start + 1, end - 1)]
    return node


def walk(root: Node) -> Iterator[Node]:
    """All nodes in document order."""
    left = [root]
    while left:
        node = left.pop()
        yield node
        left += reversed(node.children)


def sexp(root: Node) -> str:
    """The tree as an S-expression."""
    out, left = [], [root]
    while left:
        item = left.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        out.append(f"{f'{item.field}: ' if item.field else ''}({item.type}")
        left.append(")")
        for child in reversed(item.children):
            left += [child, " "]
    return "".join(out)


def compile_query(text: str) -> list[Pattern]:
    """The patterns of a query; raises ``SyntaxProblem`` for one that can't be read."""
    root, at, of = Pattern("", None), 0, None
    open_patterns = [root]
    text = text.strip()
    while at < len(text):
        token = _PATTERN.match(text, at)
        if token is None:
            raise SyntaxProblem(f"unexpected text at {at} of the query")
        at, parent = token.end(), open_patterns[-1]
        if token["mark"] == "(":
            parent.children.append(Pattern("", of))
            open_patterns.append(parent.children[-1])
            of = None
        elif token["mark"] == ")" and len(open_patterns) > 1 and parent.type and of is None:
            open_patterns.pop()
        elif token["capture"] and parent.children:
            parent.children[-1].capture = token["capture"]
        elif token["field"] and len(open_patterns) > 1:
            of = token["field"]
        elif token["type"] and len(open_patterns) > 1 and not parent.type:
            parent.type = token["type"]
        else:
            raise SyntaxProblem(f"unexpected token at {token.start()} of the query")
    if len(open_patterns) > 1:
        raise SyntaxProblem("the query ends too early")
    return root.children


def _captures(node: Node, pattern: Pattern) -> Iterator[list[tuple[str, Node]]]:
    """Every way in which ``node`` fits; depth is that of the pattern, not of the text."""
    if pattern.type not in ("_", node.type) or (pattern.field and pattern.field != node.field):
        return
    own = [(pattern.capture, node)] if pattern.capture else []

    def rest(i: int, since: int) -> Iterator[list[tuple[str, Node]]]:
        if i == len(pattern.children):
            yield []
            return
        for j in range(since, len(node.children)):
            for head in _captures(node.children[j], pattern.children[i]):
                for tail in rest(i + 1, j + 1):
                    yield head + tail

    for found in rest(0, 0):
        yield own + found


def matches(text: str, query: list[Pattern]) -> list[dict]:
    """``pattern_index`` and ``captures`` of each match, in document order."""
    source = text.encode()
    lines = [0, *(m.end() for m in re.finditer(b"\n", source))]

    def point(at: int) -> dict:
        row = bisect_right(lines, at) - 1
        return {"row": row, "column": at - lines[row]}

    def capture(name: str, node: Node) -> dict:
        return {"name": name, "text": source[node.start : node.end].decode(errors="ignore"), "start_byte": node.start, "end_byte": node.end, "start": point(node.start), "end": point(node.end)}

    return [{"pattern_index": i, "captures": [capture(*c) for c in found]} for node in walk(parse(source)) for i, p in enumerate(query) for found in _captures(node, p)]


_POINT = "struct<row: long, column: long>"
_MATCHES = f"array<struct<pattern_index: int, captures: array<struct<name: string, text: string, start_byte: long, end_byte: long, start: {_POINT}, end: {_POINT}>>>>"


def query_of(text: Column, query: str) -> Column:
    """``matches`` over a column, in Arrow batches; null for null texts and for texts that aren't JSON."""
    patterns = compile_query(query)

    def one(source: str | None) -> list[dict] | None:
        try:
            return None if source is None else matches(source, patterns)
        except SyntaxProblem:
            return None

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype(object)

    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, _MATCHES)(text)
