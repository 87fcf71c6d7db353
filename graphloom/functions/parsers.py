"""Parsers of build files, test files, C sources and documented modules, one text at a time.

Each is a plain function of one text, and a column function over it (``*_of``) that runs in Arrow
batches: rows don't depend on each other, so nothing is shuffled. Null texts give null; empty ones
give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEXEME = re.compile(r"""//[^\n]*|/\*|"(?:[^"\\]|\\.)*+\\?"?|'(?:[^'\\]|\\.)*+\\?'?""", re.DOTALL)
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_MAIN = re.compile(r"(?<!\w)main\s*\(", re.ASCII)
_BLOCK = re.compile(r"^[^\S\n]*(?P<head>(?:rule|build) [^\n]*)(?P<body>(?:\n  [^\n]*)*+)|^(?P<line>[^\n]+)", re.MULTILINE)
_TARGET_TYPE = re.compile(r"#\s*(?:Object|Link) build statements for (\S+) target (.+)")
_REFERENCE = re.compile(r"\$\{?(\w+)\}?", re.ASCII)
_ADD_TEST = re.compile(r"add_test\s*\(", re.IGNORECASE)
_ARGUMENT = re.compile(r"""\s*(?:(?P<end>\))|\[(?P<eq>=*)\[(?P<long>.*?)(?:\](?P=eq)\]|\Z)|"(?P<quoted>(?:[^"\\]|\\.)*+\\?)(?:"|\Z)|(?P<bare>[^\s)]+))""", re.DOTALL)
_DECLARATION = re.compile(r"^[^\S\n]*/\*\*(?P<doc>.*?)\*/[^\S\n]*$|^[^\S\n]*export (?:class (?P<class>\w+)\b|function (?P<function>\w+)\s*\((?P<params>[^)\n]*)\)|const (?P<const>\w+)\s*=)[^\n]*|^[^\S\n]*\S[^\n]*", re.MULTILINE | re.DOTALL)
_TAG = re.compile(r"@(param|returns?|category|configField)\b\s*(.*)", re.DOTALL)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def strip_comments(text: str) -> str:
    """``text`` with comments, strings and characters as spaces, of equal length and lines. Block comments nest."""
    out, at = [], 0
    while found := _LEXEME.search(text, at):
        end = found.end()
        if found[0] == "/*":
            depth = 1
            for edge in _COMMENT_EDGE.finditer(text, end):
                depth += 1 if edge[0] == "/*" else -1
                if depth == 0:
                    end = edge.end()
                    break
            else:
                end = len(text)
        out += [text[at : found.start()], _blank(text[found.start() : end])]
        at = end
    return "".join(out) + text[at:]


def has_main(text: str) -> bool:
    """Whether ``main(`` stands outside of comments and strings."""
    return _MAIN.search(strip_comments(text)) is not None


def _bindings(body: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in body.split("\n")[1:])}


def parse_ninja(text: str) -> dict:
    """``rules``, ``edges``, ``vars``, ``target_types`` and the ``includes`` named by one build file."""
    out = {"rules": {}, "edges": [], "vars": {}, "target_types": {}, "includes": []}
    for block in _BLOCK.finditer(text):
        line = (block["line"] or "").strip()
        word, _, rest = (block["head"] or "").partition(" ")
        if word == "rule":
            out["rules"][rest.strip()] = _bindings(block["body"])
        elif word == "build":
            made, _, recipe = rest.partition(":")
            recipe, _, order_only = recipe.strip().partition("||")
            rule, _, needed = recipe.strip().partition(" ")
            (outputs, _, more_outputs), (inputs, _, more_inputs) = made.partition("|"), needed.strip().partition("|")
            out["edges"].append({
                "outputs": outputs.split(), "implicit_outputs": more_outputs.split(), "rule": rule, "inputs": inputs.split(),
                "implicit_inputs": more_inputs.split(), "order_only": order_only.split(), "vars": _bindings(block["body"]),
            })
        elif line.startswith("#"):
            if named := _TARGET_TYPE.fullmatch(line):
                out["target_types"][named[2]] = named[1]
        elif line.startswith("include "):
            out["includes"].append(line.removeprefix("include ").strip())
        elif "=" in line:
            name, _, value = line.partition("=")
            out["vars"][name.strip()] = value.strip()
    return out


def expand(template: str, edge: dict, rule: dict[str, str], top: dict[str, str]) -> str:
    """References replaced: ``in`` and ``out``, the edge's variables (again expanded), the rule's, the file's, else nothing.

    A variable that refers to itself is an error.
    """

    def resolve(text: str, within: tuple[str, ...]) -> str:
        def value(found: re.Match) -> str:
            name = found[1]
            if name in ("in", "out"):
                return " ".join(edge[f"{name}puts"])
            if name in within:
                raise ValueError(f"variable {name} refers to itself")
            return resolve(edge["vars"][name], (*within, name)) if name in edge["vars"] else rule.get(name, top.get(name, ""))

        return _REFERENCE.sub(value, text)

    return resolve(template, ())


def commands(text: str) -> list[dict]:
    """Each edge of one build file with its rule's command, expanded."""
    parsed = parse_ninja(text)
    lists = ("outputs", "implicit_outputs", "rule", "inputs", "implicit_inputs", "order_only")
    rules = parsed["rules"]
    return [{k: e[k] for k in lists} | {"command": expand(rules.get(e["rule"], {}).get("command", ""), e, rules.get(e["rule"], {}), parsed["vars"])} for e in parsed["edges"]]


def parse_ctest(text: str) -> list[dict]:
    """``name`` and ``command`` of each ``add_test``; arguments are bare, quoted or in long brackets."""
    out, at = [], 0
    while call := _ADD_TEST.search(text, at):
        at, words = call.end(), []
        while argument := _ARGUMENT.match(text, at):
            at = argument.end()
            if argument["end"]:
                break
            if argument["quoted"] is not None:
                words.append(re.sub(r"\\(.)", r"\1", argument["quoted"], flags=re.DOTALL))
            else:
                words.append(argument["long"] if argument["long"] is not None else argument["bare"])
        if words:
            out.append({"name": words[0], "command": words[1:]})
    return out


def _typed(text: str) -> tuple[str, str]:
    """A leading type in braces, which may hold braces, and the rest."""
    depth = 0
    for brace in re.finditer(r"[{}]", text) if text.startswith("{") else ():
        depth += 1 if brace[0] == "{" else -1
        if depth == 0:
            return text[1 : brace.start()], text[brace.end() :].lstrip()
    return "", text


def parse_doc(lines: list[str]) -> dict:
    """A doc block's summary, parameters, configuration fields, return value and category; other tags are left out."""
    doc = {"summary": "", "params": [], "fields": [], "returns": None, "category": None}
    summary = []
    for line in filter(None, (raw.strip() for raw in lines)):
        tag = _TAG.fullmatch(line)
        if tag is None:
            if not line.startswith("@"):
                summary.append(line)
        elif tag[1] == "category":
            if tag[2]:
                doc["category"] = tag[2].split()[0]
        else:
            of_type, rest = _typed(tag[2])
            if tag[1].startswith("return"):
                doc["returns"] = {"type": of_type, "description": rest.strip()}
            else:
                name, _, description = rest.partition(" ")
                doc["params" if tag[1] == "param" else "fields"].append({"type": of_type, "name": name, "description": description.strip()})
    return doc | {"summary": " ".join(summary)}


def parse_module(text: str) -> list[dict]:
    """Exports with the doc block right before each (blank lines allowed); names that begin with ``__`` are left out."""
    out, pending = [], None
    for found in _DECLARATION.finditer(text):
        if found["doc"] is not None:
            pending = [re.sub(r"^\*\s?", "", line.strip()) for line in found["doc"].split("\n")]
            continue
        kind = next((k for k in ("class", "function", "const") if found[k]), None)
        if kind and not found[kind].startswith("__"):
            out.append({"name": found[kind], "params": found["params"] or "", "kind": kind, "doc": parse_doc(pending) if pending is not None else None})
        pending = None
    return out


def _column(function: Callable, schema: str) -> Callable[[Column], Column]:
    """``function`` over a column of texts, in Arrow batches."""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else function(text)).astype(object)

    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    # declared on use: the schema is parsed by a session
    return lambda texts: F.pandas_udf(batch, schema)(texts)


_FIELD = "struct<type: string, name: string, description: string>"
strip_comments_of = _column(strip_comments, "string")
has_main_of = _column(has_main, "boolean")
commands_of = _column(commands, "array<struct<outputs: array<string>, implicit_outputs: array<string>, rule: string, inputs: array<string>, implicit_inputs: array<string>, order_only: array<string>, command: string>>")
includes_of = _column(lambda text: parse_ninja(text)["includes"], "array<string>")
ctest_of = _column(parse_ctest, "array<struct<name: string, command: array<string>>>")
module_of = _column(parse_module, f"array<struct<name: string, params: string, kind: string, doc: struct<summary: string, params: array<{_FIELD}>, fields: array<{_FIELD}>, returns: struct<type: string, description: string>, category: string>>>")


def build_targets(sources: DataFrame) -> DataFrame:
    """``folder``, ``kind`` (binary where a source has an entry point, else library) and sorted ``sources`` of C files (``path``, ``text``)."""
    rows = sources.select("path", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"), has_main_of("text").alias("_main"))
    kind = F.when(F.bool_or(F.coalesce("_main", F.lit(False))), "binary").otherwise("library")
    return rows.groupBy("folder").agg(kind.alias("kind"), F.array_sort(F.collect_set("path")).alias("sources"))
