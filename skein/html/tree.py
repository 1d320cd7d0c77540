"""A tolerant element tree with the text measures that denoising asks for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg canvas iframe object embed audio video map head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Open elements that a start tag closes, up to the named scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Deeper elements become siblings: their text stays, and walks over the tree can recurse.
MAX_DEPTH = 200
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = re.compile(r"(<(script|style)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>)(.*?)(</\2\s*>|\Z)", re.S | re.I)
_INSTRUCTION = re.compile(r"<\?[^>]*>")
_STRAY = re.compile(r"<(?=[^a-zA-Z/!])")


def squash(text: str) -> str:
    """Runs of Unicode white space as one blank, trimmed."""
    return " ".join(text.split())


def repair(source: str) -> str:
    """Markup that would mislead a tolerant parser: script and style bodies (JSON is kept, defused), ``<?...>`` and a ``<`` that opens nothing."""

    def body(m: re.Match) -> str:
        return m[1] + (m[3].replace("<", "&lt;") if "json" in m[1].lower() else "") + m[4]

    if "<" not in source:
        return source
    low = source if "<script" in source or "<style" in source else source.lower()
    out = _RAW.sub(body, source) if "<script" in low or "<style" in low else source
    if "<?" in out:
        out = _INSTRUCTION.sub("", out)
    return _STRAY.sub("&lt;", out)


class Node:
    """An element, or with an empty name a text."""

    __slots__ = ("name", "attributes", "parent", "children", "text", "size", "text_len", "link_len", "has_block", "order")

    def __init__(self, name: str, parent: Node | None, attributes: str = "", text: str = ""):
        self.name, self.parent, self.text = name, parent, text
        self.attributes: str | dict[str, str] = attributes
        self.children: list[Node] = []
        self.size = self.text_len = self.link_len = self.order = 0
        self.has_block = False

    def get(self, key: str) -> str | None:
        if isinstance(self.attributes, str):
            self.attributes = {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(self.attributes)}
        return self.attributes.get(key)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def ancestors(self, most: int = 1 << 30) -> Iterator[Node]:
        node = self.parent
        while node is not None and most > 0:
            yield node
            node, most = node.parent, most - 1

    def raw_text(self) -> str:
        return "".join(n.text for n in self.walk() if not n.name)

    def inner_text(self) -> str:
        """Visible text, parts joined by blanks."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if not node.name:
                out.append(node.text)
            elif node.name not in SILENT or node is self:
                stack.extend(reversed(node.children))
        return squash(" ".join(out))

    @property
    def link_density(self) -> float:
        return min(1.0, self.link_len / self.text_len) if self.text_len else 0.0

    @property
    def text_ratio(self) -> float:
        return min(1.0, self.text_len / self.size) if self.size else 0.0

    @property
    def signature(self) -> str:
        """What the element's attributes say it is, lower-case."""
        words = [self.get(k) for k in ("class", "id", "role", "data-testid", "aria-label", "itemprop")]
        out = " ".join(w for w in words if w).lower()
        if isinstance(self.attributes, dict) and any(k.startswith(("data-ad", "data-google-ad")) for k in self.attributes):
            out += " advertisement"
        return out


class Document:
    """The tree of a page: ``root`` is a nameless-page element that holds everything."""

    def __init__(self, source: str):
        self.root = Node("#page", None)
        stack = [self.root]

        def add(name: str, attributes: str = "", text: str = "") -> Node:
            node = Node(name, stack[-1], attributes, text)
            stack[-1].children.append(node)
            return node

        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            stop = m.start() if m else n
            if stop > at:
                piece = source[at:stop]
                add("", text=unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                    if stack[i].name == "table" and name not in ("table", "body", "html"):
                        break  # an end tag doesn't reach out of a table
                continue
            if name in BLOCKS:  # a block ends an open paragraph with the inline elements in it
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p":
                        del stack[i:]
                        break
                    if stack[i].name in BLOCKS:
                        break
            if name in CLOSES:
                close, scope = CLOSES[name]
                lowest = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in scope:
                        break
                    if stack[i].name in close:
                        lowest = i
                if lowest is not None:
                    del stack[lowest:]
            node = add(name, m[3])
            if name not in VOID and not m[3].endswith("/") and len(stack) < MAX_DEPTH:
                stack.append(node)
        self.nodes = list(self.root.walk())
        self._measure()
        #: Text of the body, or of the first element where there is no body.
        self.total = next((x.text_len for x in self.nodes if x.name == "body"), next((x.text_len for x in self.nodes[1:] if x.name), 0))

    def _measure(self) -> None:
        """Sums over subtrees, in one pass from the leaves up."""
        for i, node in enumerate(self.nodes):
            node.order = i
        for node in reversed(self.nodes):
            if not node.name:
                node.text_len = len(node.text.strip())
                node.size = len(node.text)
            else:
                node.size += 2 * len(node.name) + 5 + min(len(node.attributes), 512)  # type: ignore[arg-type]
                if node.name in SILENT:
                    node.text_len = node.link_len = 0
                elif node.name == "a":
                    node.link_len = node.text_len
            up = node.parent
            if up is not None:
                up.size += node.size
                up.text_len += node.text_len
                up.link_len += node.link_len
                up.has_block = up.has_block or node.has_block or node.name in BLOCKS

    def dominant(self, node: Node) -> bool:
        return self.total > 0 and node.text_len * 2 > self.total
