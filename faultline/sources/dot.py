"""Property graphs from Graphviz DOT files: each file is parsed where it is read, into node and edge tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|->|--|[\[\]{};,=:]|[^\s\[\]{};,="<>:-][^\s\[\]{};,="<>:]*(?:-(?!>|-)[^\s\[\]{};,="<>:]+)*|<', re.S)
_SKIPPED = re.compile(r"/\*.*?\*/|^\s*#[^\n]*|//[^\n]*(?=\n)", re.S | re.M)

BOTH = "service string, node_id string, ord long, label string, name string, full_name string, line string, code string, attrs map<string,string>, src string, dst string"


def clean(value: str | None) -> str:
    """A value without white space and quotes around it, and with HTML entities as characters."""
    return html.unescape((value or "").strip().strip('"'))


def tokens(text: str) -> Iterator[str]:
    """DOT tokens; HTML-like values in angle brackets are one token each."""
    at = 0
    plain = _SKIPPED.sub(" ", text) if ("/*" in text or "\n#" in text) and '"' not in text else text
    while m := _TOKEN.search(plain, at):
        if m[0] == "<":
            depth, end = 1, m.end()
            while depth and end < len(plain):
                depth += (plain[end] == "<") - (plain[end] == ">")
                end += 1
            yield plain[m.start() : end]
            at = end
        else:
            yield m[0]
            at = m.end()


def _value(token: str) -> str:
    return token[1:-1].replace('\\"', '"') if token[:1] == '"' else token


def parse(text: str) -> tuple[dict[str, dict[str, str]], list[tuple[str, str, dict[str, str]]]]:
    """Nodes in order of appearance with their attributes, and edges; parallel edges stay."""
    nodes: dict[str, dict[str, str]] = {}
    edges: list[tuple[str, str, dict[str, str]]] = []
    found = list(tokens(text))
    i = next((k + 1 for k, t in enumerate(found) if t == "{"), len(found))
    while i < len(found):
        t = found[i]
        if t in (";", ",", "{", "}"):
            i += 1
            continue
        if t in ("node", "edge", "graph", "subgraph") or (i + 1 < len(found) and found[i + 1] == "="):
            i += 1 if t == "subgraph" else 0
            if i + 1 < len(found) and found[i + 1] == "=":
                i += 3
            elif t != "subgraph" and i + 1 < len(found) and found[i + 1] == "[":
                i = found.index("]", i) + 1
            else:
                i += 1
            continue
        chain = [_value(t)]
        i += 1
        while i < len(found) and found[i] == ":":  # ports
            i += 2
        while i + 1 < len(found) and found[i] in ("->", "--"):
            chain.append(_value(found[i + 1]))
            i += 2
            while i < len(found) and found[i] == ":":
                i += 2
        attrs: dict[str, str] = {}
        if i < len(found) and found[i] == "[":
            i += 1
            while i < len(found) and found[i] != "]":
                if i + 2 < len(found) and found[i + 1] == "=":
                    attrs[_value(found[i])] = _value(found[i + 2])
                    i += 3
                else:
                    i += 1
            i += 1
        for name in chain:
            nodes.setdefault(name, {})
        if len(chain) == 1:
            nodes[chain[0]].update(attrs)
        edges += [(a, b, attrs) for a, b in zip(chain, chain[1:], strict=False)]
    return nodes, edges


def _label(attrs: dict[str, str]) -> str:
    """METHOD, CALL, ... in either dialect: the label itself, or a kind in angle brackets in it."""
    label = clean(attrs.get("label"))
    inner = re.search(r"<\s*([A-Z_]+)\s*>", label)
    return inner[1] if inner else label


def read_dot(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all files that the paths name; a file's folder is its service."""
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("service"),
        F.decode("content", "UTF-8").alias("text"),
    )

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            for service, text in zip(frame["service"], frame["text"], strict=True):
                nodes, edges = parse(text)
                found = [
                    (
                        service,
                        n,
                        i,
                        _label(a),
                        clean(a.get("NAME")) or _named(a),
                        clean(a.get("FULL_NAME")),
                        clean(a.get("LINE_NUMBER")),
                        clean(a.get("CODE")),
                        {k: clean(v) for k, v in a.items()},
                        None,
                        None,
                    ) for i,
                    (n, a) in enumerate(nodes.items())
                ]
                found += [(service, None, i, clean(x.get("label")), None, None, None, None, None, a, b) for i, (a, b, x) in enumerate(edges)]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in BOTH.split(", ")])

    # each file is parsed once; nodes and edges are read from what that gives
    both = cut(files.mapInPandas(rows, BOTH))
    nodes = both.where("src is null").select(
        "service",
        "node_id",
        F.col("ord").alias("node_ord"),
        "label",
        "name",
        "full_name",
        "line",
        "code",
        "attrs",
    )
    return nodes, both.where("src is not null").select("service", "src", "dst", "label", F.col("ord").alias("edge_ord"))


def _named(attrs: dict[str, str]) -> str:
    found = re.search(r'name:\s*"([^"]+)"', html.unescape(attrs.get("label") or ""))
    return found[1] if found else ""


def ast_edges(edges: DataFrame) -> DataFrame:
    return edges.where("label = 'AST'").select("service", "src", "dst")
