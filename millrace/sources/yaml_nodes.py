"""YAML documents as tables of nodes: keys and items with their place in the tree, numbered so that containment is an interval.

A node holds the nodes whose ``pre`` lies in ``(pre, post]``.  Aliases and merge keys hold copies of what their anchors hold, with the lines of the
anchor.  One row a file goes in, so that nothing is shuffled; a file that is not read to its end has a row of kind ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.frames import frames

SCHEMA = "path string, pre int, post int, parent int, depth int, kind string, key string, value string, trail array<string>, line int, end_line int"
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},-][^#]*?|-[^\s#][^#]*?|<<)\s*:(?=\s|$)""")
MARKS = re.compile(r"(?:(?:&(\S+)|!\S*)(?:\s+|$))+")
BLOCK = re.compile(r"[|>][-+0-9]*$")
#: Copies that aliases of a file may make, as a multiple of its own nodes; beyond it the file is an error (documents can be built to explode).
COPIES = 50


@dataclass
class Node:
    kind: str
    key: str
    indent: int
    line: int
    value: str | None = None
    alias: str | None = None
    end: int = 0
    inner: list[Node] = field(default_factory=list)


def _bare(text: str) -> str:
    """Text before a comment; a ``#`` counts after white space and outside of quotes."""
    quote = ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (k == 0 or text[k - 1] in " \t:[{,-"):
            quote = c
        elif c == "#" and (k == 0 or text[k - 1] in " \t"):
            return text[:k].rstrip()
    return text.rstrip()


def _plain(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" else text


def _open(text: str) -> int:
    """Brackets of a flow value that are still open."""
    depth, quote = 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c in "[{") - (c in "]}")
    return depth


def _flow(text: str, line: int) -> list[Node]:
    """Nodes of the inside of a flow value."""
    parts, depth, quote, at = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "," and not depth:
            parts.append(text[at:k])
            at = k + 1
        else:
            depth += (c in "[{") - (c in "]}")
    parts.append(text[at:])
    out = []
    for part in (p.strip() for p in parts):
        if not part:
            continue
        m = KEY.match(part)
        node = Node("key", _plain(m[1]), 0, line, end=line) if m else Node("item", str(len(out)), 0, line, end=line)
        _fill(node, part[m.end() :].strip() if m else part)
        out.append(node)
    return out


def _fill(node: Node, rest: str) -> None:
    """Value, alias or flow content of a node."""
    if rest[:1] in ("[", "{") and rest[-1:] in ("]", "}"):
        node.inner += _flow(rest[1:-1], node.line)
    elif rest.startswith("*") and len(rest) > 1 and " " not in rest:
        node.alias = rest[1:]
    elif rest:
        node.value = _plain(rest)


def parse(text: str) -> list[Node]:
    """Trees of a file's documents, anchors resolved."""
    top = Node("root", "", -1, 0)
    stack, anchors, block, made = [top], {}, None, 0
    lines = text.replace("\t", "  ").splitlines()
    k = -1
    while k + 1 < len(lines):
        k += 1
        raw, number = lines[k], k + 1
        indent = len(raw) - len(raw.lstrip(" "))
        if block is not None:
            if not raw.strip() or indent > block.indent:
                block.value = f"{block.value}\n{raw.strip()}" if block.value else raw.strip()
                for node in stack:
                    node.end = number if raw.strip() else node.end
                continue
            block = None
        content = _bare(raw[indent:])
        if not content or content.startswith("%"):
            continue
        if indent == 0 and re.match(r"(---|\.\.\.)(\s|$)", content):
            stack, content = [top], content[3:].strip()
            if not content:
                continue
        while content == "-" or content.startswith("- "):
            while len(stack) > 1 and (stack[-1].indent > indent or stack[-1].indent == indent and stack[-1].kind == "item"):
                stack.pop()
            item = Node("item", str(sum(n.kind == "item" for n in stack[-1].inner) if len(stack[-1].inner) < 100 else len(stack[-1].inner)), indent, number)
            stack[-1].inner.append(item)
            stack.append(item)
            inside = content[1:].lstrip(" ")
            indent += len(content) - len(inside)
            content = inside
        m = KEY.match(content)
        if m:
            while len(stack) > 1 and stack[-1].indent >= indent:
                stack.pop()
            node = Node("key", _plain(m[1]), indent, number)
            stack[-1].inner.append(node)
            stack.append(node)
            content = content[m.end() :].strip()
        node = stack[-1]
        for x in stack:
            x.end = number
        mark = MARKS.match(content)
        if mark:
            if mark[1]:
                anchors[mark[1]] = node
            content = content[mark.end() :].strip()
        if BLOCK.match(content):
            block = node
            continue
        while content[:1] in ("[", "{") and _open(content) > 0 and k + 1 < len(lines):
            k += 1
            content = f"{content} {_bare(lines[k].strip())}"
            for x in stack:
                x.end = k + 1
        if node.line < number and node.value is not None and content:
            node.value = f"{node.value} {_plain(content)}"  # a plain value that goes on
        else:
            _fill(node, content)
    budget = COPIES * max(1, len(lines))

    def resolve(node: Node, within: frozenset) -> None:
        nonlocal made
        within |= {id(node)}
        if node.alias is not None and node.alias in anchors and not within & {node.alias, id(anchors[node.alias])}:
            source = anchors[node.alias]
            node.value, node.inner, within = source.value, [_copy(n) for n in source.inner], within | {node.alias}
        merged: list[Node] = []
        for child in node.inner:
            made += 1
            if made > budget:
                raise OverflowError("aliases make too many copies")
            resolve(child, within)
        for child in node.inner:
            if child.key == "<<" and child.kind == "key":
                merged += [g for n in ([child] if not child.inner or child.inner[0].kind == "key" else child.inner) for g in n.inner]
        own = {n.key for n in node.inner}
        if merged:
            node.inner = [n for n in node.inner if n.key != "<<"] + [n for n in {n.key: n for n in reversed(merged)}.values() if n.key not in own]

    resolve(top, frozenset())
    return top.inner


def _copy(node: Node) -> Node:
    return Node(node.kind, node.key, node.indent, node.line, node.value, node.alias, node.end, [_copy(n) for n in node.inner])


def rows_of(path: str, text: str) -> list[tuple]:
    """Rows of a file, numbered in order of the tree."""
    out: list[list] = []

    def add(node: Node, parent: int | None, trail: list[str]) -> None:
        pre, here = len(out) + 1, [*trail, node.key]
        out.append([path, pre, pre, parent, len(trail), node.kind, node.key, None if node.value is None else node.value.rstrip("\n"), here, node.line, max(node.end, node.line)])
        for child in node.inner:
            add(child, pre, here)
        out[pre - 1][2] = len(out)

    try:
        for node in parse(text):
            add(node, None, [])
    except (OverflowError, RecursionError) as e:
        return [(path, 1, 1, None, 0, "error", None, str(e)[:200], [], 1, 1)]
    return [tuple(r) for r in out]


def config_nodes(files: DataFrame) -> DataFrame:
    """Nodes of YAML files (``path, text``): ``path, pre, post, parent, depth, kind, key, value, trail, line, end_line``.

    ``kind``: ``key``, ``item`` or ``error``; ``trail``: keys (or item numbers) from the top to the node.  Null and empty texts have
    no nodes; repeated rows give repeated nodes.  Block and flow style, quoted keys and values, block scalars, anchors and merge keys are read; complex keys and tags are not.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = (r for path, text in zip(batch["path"], batch["text"]) for r in rows_of(path, text or ""))
            yield from (part.astype({"parent": "Int32"}) for part in frames(rows, names))

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def inside(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes within nodes: all of ``nodes`` with ``outer`` (``path, pre, post`` and columns of its own, not named as those of nodes) that holds them, by path and interval."""
    o = outer.withColumnsRenamed({"path": "_path", "pre": "_pre", "post": "_post"})
    held = (F.col("path") == F.col("_path")) & (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_post"))
    return nodes.join(o, held).drop("_path", "_pre", "_post")
