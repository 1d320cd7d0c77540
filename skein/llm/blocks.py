"""Text blocks of an HTML page with the little structure that block rules need."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>", re.S)
_SILENT = re.compile(r"<(script|style|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_BLOCKY = re.compile(r"<(?:p|div|h[1-6]|ul|ol|table|section|article|form|blockquote)\b", re.I)
_TABLE_END = re.compile(r"</table\s*>", re.I)
_ROW = re.compile(r"</?tr\b[^>]*>", re.I)
_ANY_TAG = re.compile(r"<[^<>]*>")
_GAPS = re.compile(r"[\s​‌‍⁠﻿­]+")
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

_CONTAINERS = frozenset("body div section article main nav aside header footer table tr td th tbody thead form noscript center dl figure details".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd figcaption summary caption address".split())
_BREAKS = frozenset("ul ol hr".split())


class Block(NamedTuple):
    key: str  # the text without white space and invisible characters
    text: str
    tag: str  # the leaf tag, or the container's where text stands in it directly
    node: int  # innermost container
    link_share: float
    marks: str  # class and id of the leaf, or of the container if it holds nothing but this text


class Page(NamedTuple):
    blocks: list[Block]
    parents: list[int]  # of containers; 0 is the page
    tags: list[str]
    marks: list[str]
    paths: list[str]  # tags and attributes from the page down, which pages of one template share


def squeeze(text: str) -> str:
    """A text's identity apart from white space and invisible characters."""
    return _GAPS.sub("", text)


def _marks(attributes: str) -> str:
    return " ".join(m.strip("\"'") for m in _CLASS.findall(attributes)).lower() if attributes else ""


def parse(body: str | None) -> Page:
    """Blocks in document order; never fails, whatever the markup.

    A block tag closes an open paragraph, an end tag closes back to its nearest open match, an
    unmatched end tag is ignored, and text outside any leaf belongs to its container.
    """
    parents, tags, marks, paths = [0], ["page"], [""], [""]
    blocks: list[Block] = []
    if not body or "<" not in body:
        return Page(blocks, parents, tags, marks, paths)
    s = _SILENT.sub(" ", body)
    stack = [0]
    leaf, leaf_marks = "", ""
    parts: list[str] = []
    link = 0
    in_link = False

    def flush() -> None:
        nonlocal parts, link
        if parts:
            raw = "".join(parts)
            text = (html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                key = _GAPS.sub("", text)
                if key:
                    blocks.append(Block(key, text, leaf or tags[stack[-1]], stack[-1], min(1.0, link / max(1, len(raw.strip()))), leaf_marks or ""))
            parts = []
        link = 0

    at, n = 0, len(s)
    find = _TOKEN.search
    while at < n:
        m = find(s, at)
        stop = m.start() if m else n
        if stop > at:
            t = s[at:stop]
            parts.append(t)
            if in_link:
                link += len(t.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name in _LEAVES:
                flush()
                leaf, leaf_marks = "", ""
            elif name in _CONTAINERS:
                flush()
                leaf, leaf_marks = "", ""
                in_link = False
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == name:
                        del stack[i:]
                        break
            elif name in _BREAKS:
                flush()
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            parts.append("\n")
        elif name in _LEAVES:
            flush()
            leaf, leaf_marks = name, _marks(m[3])
            in_link = False
        elif name == "table":
            flush()
            end = _TABLE_END.search(s, at)
            stop = end.start() if end else n
            if not _BLOCKY.search(s, at, stop):  # a data table is one block
                rows = [" ".join(_ANY_TAG.sub(" ", r).split()) for r in _ROW.split(s[at:stop])]
                text = html.unescape("\n".join(r for r in rows if r))
                if squeeze(text):
                    blocks.append(Block(squeeze(text), text, "table", stack[-1], 0.0, _marks(m[3])))
                at = end.end() if end else n
                leaf, leaf_marks = "", ""
                continue
            leaf, leaf_marks = "", ""
            _open(stack, parents, tags, marks, paths, name, m[3])
        elif name in _CONTAINERS:
            flush()
            leaf, leaf_marks = "", ""
            in_link = False
            if name in ("td", "th", "tr"):  # cells and rows close their open siblings
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == "table":
                        break
                    if tags[stack[i]] == name or (name == "tr" and tags[stack[i]] in ("td", "th")):
                        del stack[i:]
                        break
            _open(stack, parents, tags, marks, paths, name, m[3])
        elif name in _BREAKS:
            flush()
            leaf, leaf_marks = "", ""
    flush()
    # A container that holds one text and nothing else lends it its marks.
    alone: dict[int, int] = {}
    for b in blocks:
        alone[b.node] = alone.get(b.node, 0) + 1
    inner = set(parents[1:])
    blocks = [
        b._replace(marks=marks[b.node], node=parents[b.node]) if b.tag not in _LEAVES and b.tag != "table" and alone[b.node] == 1 and b.node not in inner else b
        for b in blocks
    ]
    return Page(blocks, parents, tags, marks, paths)


def _open(stack: list[int], parents: list[int], tags: list[str], marks: list[str], paths: list[str], name: str, attributes: str) -> None:
    parents.append(stack[-1])
    tags.append(name)
    marks.append(_marks(attributes))
    paths.append(f"{paths[stack[-1]]}>{name}{attributes.rstrip()}")
    stack.append(len(parents) - 1)
