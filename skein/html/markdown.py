"""Content elements as addressable Markdown units."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import urljoin

from skein.functions.text import CODE_LANGUAGES
from skein.html.denoise import DROPPED, DenoiseConfig, is_hidden, is_noise
from skein.html.tree import HEADINGS, Document, Node, squash
from skein.operators.slim import estimate

INLINE = frozenset(
    "a abbr b bdi bdo br cite code data del dfn em font i img ins kbd mark math q s samp small span strike strong sub sup time tt u var wbr".split()
)
INSPECT_BYTES = 2048
_CITED = ("reference", "citation", "footnote", "cite")
_MARKED = re.compile(r"[\\\[\]*`~#>]")
_FORGED = re.compile(r"^( {0,3})(#{1,2})( |$)", re.M)  # T9: what would start a heading
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_LANGUAGE = re.compile(r"(?:language-|lang-|highlight-source-|highlight-text-|sourceCode-)(.+)")
_PLAIN_PARAGRAPHS = frozenset("p dd dt figcaption summary address".split())
_SECTIONING = frozenset((*HEADINGS, "table", "section", "article", "aside", "nav", "footer", "header", "figure"))


@dataclass(frozen=True)
class RenderOptions:
    include_links: bool = True
    include_images: bool = False
    include_tables: bool = True


class Unit(NamedTuple):
    kind: str
    level: int
    text: str
    markdown: str
    heading_path: list[str]
    tokens: int


def plain(markdown: str) -> str:
    """The text of inline Markdown: escapes resolved, link targets and emphasis marks gone."""
    if not _MARKED.search(markdown):
        return squash(markdown)
    out: list[str] = []
    in_label = False
    i, n = 0, len(markdown)
    while i < n:
        c = markdown[i]
        i += 1
        if c == "\\":
            if _ESCAPED.match(markdown, i - 1):
                out.append(markdown[i])
                i += 1
            else:
                out.append(c)
        elif c == "[":
            in_label = True
        elif c == "]":
            in_label = False
            if markdown.startswith("(", i):
                depth = 0
                while i < n:
                    depth += (markdown[i] == "(") - (markdown[i] == ")")
                    i += 1
                    if not depth:
                        break
        elif in_label or c not in "*`~#>":
            out.append(c)
    return squash("".join(out))


def code_language(name: str, bare: bool = False) -> str | None:
    low = name.strip().strip('"').lower()
    ok = re.fullmatch(r"[a-z0-9+#-]{1,16}", low) and (not bare or low in CODE_LANGUAGES)
    return low if ok else None


class Writer:
    """Walks a content element and collects its units."""

    def __init__(self, doc: Document, cfg: DenoiseConfig, options: RenderOptions, base: str | None):
        self.doc, self.cfg, self.options, self.base = doc, cfg, options, base
        self.units: list[Unit] = []
        self.visited = self.dropped = 0
        self.trail: list[tuple[int, str]] = []
        self.depth = 0

    @property
    def length(self) -> int:
        return sum(len(u.text) for u in self.units)

    def emit(self, kind: str, level: int, text: str, markdown: str) -> None:
        if kind not in ("heading", "code"):
            markdown = _FORGED.sub(r"\1\\\2\3", markdown)
        names = [t for _, t in (self.trail[:-1] if kind == "heading" else self.trail)]
        self.units.append(Unit(kind, level, text, markdown, names, estimate(markdown)))

    def walk(self, node: Node, judge: bool = True) -> None:
        self.visited += 1
        if judge and is_noise(self.doc, node, self.cfg):
            self.dropped += sum(1 for _ in node.walk())
            return
        name = node.name
        if name in HEADINGS:
            inline = squash(self.inline_children(node))
            if inline:
                level, text = HEADINGS.index(name) + 1, plain(inline)
                while self.trail and self.trail[-1][0] >= level:
                    self.trail.pop()
                self.trail.append((level, text))
                self.emit("heading", level, text, f"{'#' * level} {inline}")
        elif not name:
            text = squash(self.inline(node))
            if len(text) >= self.cfg.min_block_len:
                self.emit("paragraph", 0, text, text)
        elif name in _PLAIN_PARAGRAPHS and not node.has_block:
            text = squash(self.inline_children(node))
            if text:
                self.emit("paragraph", 0, plain(text), text)
        elif name == "pre":
            self.code(node)
        elif name == "blockquote" and not node.has_block:
            text = node.inner_text()
            if text:
                self.emit("quote", 0, text, f"> {text}")
        elif name in ("ul", "ol", "dl"):
            self.depth += 1
            self.walk_children(node)
            self.depth -= 1
        elif name == "li":
            self.list_item(node)
        elif name == "table" and self.is_data_table(node):
            if self.options.include_tables:
                self.table(node)
        elif name not in ("hr", "br"):
            self.walk_children(node)

    def is_inline(self, node: Node) -> bool:
        return not node.name or (node.name in INLINE and (node.size <= INSPECT_BYTES or not node.has_block))

    def walk_children(self, node: Node) -> None:
        """Blocks one by one; runs of inline children between them are paragraphs of their own if long enough."""
        run: list[Node] = []
        for child in [*node.children, None]:
            if child is not None and self.is_inline(child):
                run.append(child)
                continue
            if run:
                image = self.options.include_images and any(x.name == "img" for x in run)
                text = squash("".join(self.inline(x) for x in run))
                bare = plain(text)
                if image or len(bare) >= self.cfg.min_block_len:
                    self.emit("paragraph", 0, bare, text)
                run = []
            if child is not None:
                self.walk(child)

    def list_item(self, node: Node) -> None:
        text = squash("".join(self.inline(x) for x in node.children if self.is_inline(x)))
        if text:
            depth = min(6, max(0, self.depth - 1))
            self.emit("list_item", depth, plain(text), f"{'  ' * depth}- {text}")
        for child in node.children:
            if not self.is_inline(child):
                self.walk(child)

    def code(self, node: Node) -> None:
        body = node.raw_text().rstrip("\n")
        if body.strip():
            longest = max(map(len, re.findall("`+", body)), default=0)
            fence = "`" * (max(2, longest) + 1)
            self.emit("code", 0, body, f"{fence}{self.language(node)}\n{body}\n{fence}")

    def language(self, node: Node) -> str:
        """The code's language from the marks of the element, of the first ones inside and of two around it."""
        near = [x for x in node.walk() if x.name][:9]
        for x in [*near, *node.ancestors(2)]:
            for token in (x.get("class") or "").split():
                m = _LANGUAGE.fullmatch(token)
                found = (m and code_language(m[1])) or code_language(token, bare=True)
                if found:
                    return found
            for key in ("data-lang", "data-language", "data-code-language"):
                found = code_language(x.get(key) or "")
                if found:
                    return found
        return ""

    def is_data_table(self, node: Node) -> bool:
        if node.text_len > 20_000:
            return False
        inside = 0
        for x in node.walk():
            inside += 1
            if inside > 30_000 or (x is not node and x.name in _SECTIONING):
                return False
        return True

    def table(self, node: Node) -> None:
        rows, headed = [], False
        for tr in node.walk():
            if tr.name != "tr":
                continue
            cells = [x for x in tr.children if x.name in ("td", "th")]
            texts = [squash(self.inline_children(c)).replace("|", r"\|") for c in cells]
            if any(texts):
                if not rows:
                    headed = any(c.name == "th" for c in cells)
                rows.append(texts)
        if not rows:
            return
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        head, body = (rows[0], rows[1:]) if headed else ([""] * width, rows)
        lines = ["| " + " | ".join(r) + " |" for r in (head, ["---"] * width, *body)]
        self.emit("table", 0, plain("\n".join(lines)), "\n".join(lines))

    def inline_children(self, node: Node) -> str:
        return "".join(self.inline(x) for x in node.children)

    def inline(self, node: Node) -> str:
        name = node.name
        if not name:
            return node.text.replace("[", r"\[").replace("]", r"\]")
        if name in DROPPED or is_hidden(node):
            return ""
        if name == "br":
            return "\n"
        if name == "img":
            source = self.resolve(node.get("src")) or self.resolve(node.get("data-src"))
            label = (node.get("alt") or "").replace("[", r"\[").replace("]", r"\]")
            return f"![{label}]({source})" if self.options.include_images and source else ""
        if name in ("code", "kbd", "samp", "tt"):
            text = node.inner_text()
            return f"`{text}`" if text else ""
        if name == "sup":
            return self.superscript(node)
        if name == "math":
            return self.math(node)
        text = self.inline_children(node)
        if name == "a":
            target = self.resolve(node.get("href"))
            linked = self.options.include_links and text.strip() and target and not target.startswith("javascript:")
            return f"[{text.strip()}]({target})" if linked else text
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "dfn": "*", "cite": "*", "var": "*", "del": "~~", "s": "~~", "strike": "~~"}.get(name)
        if mark and text.strip():
            return (" " if text[0].isspace() else "") + mark + text.strip() + mark + (" " if text[-1].isspace() else "")
        return "" if mark else text

    def superscript(self, node: Node) -> str:
        """A reference mark vanishes, an exponent gets a caret, anything else stays."""
        text = node.inner_text()
        bracketed = text[:1] + text[-1:] in ("[]", "()") and any(c.isdigit() for c in text)
        if not text or bracketed or any(x.name == "a" for x in node.walk()) or any(w in node.signature for w in _CITED):
            return ""
        exponent = re.fullmatch(r"[0-9+\-.,()]*[0-9][0-9+\-.,()]*", text)
        return f"^{text}" if exponent else text

    def math(self, node: Node) -> str:
        notes = [x for x in node.walk() if x.name in ("annotation", "annotation-xml")]
        tex = next((x for x in notes if (x.get("encoding") or "").lower() == "application/x-tex"), None)
        if tex is not None:
            source = squash(tex.raw_text())
        else:
            inside = {id(y) for x in notes for y in x.walk()}
            source = squash("".join(x.text for x in node.walk() if not x.name and id(x) not in inside))
        source = source.replace("[", r"\[").replace("]", r"\]")
        return f"${source}$" if tex is not None and source else source

    def resolve(self, target: str | None) -> str | None:
        target = (target or "").strip()
        if not target:
            return None
        try:
            return urljoin(self.base, target) if self.base else target
        except ValueError:
            return None
