"""Feeds, sitemaps, robots files and result pages, parsed one document at a time."""

from __future__ import annotations

import json
import re
from html import unescape
from html.entities import html5
from urllib.parse import parse_qs, urljoin, urlsplit

from skein.html.tree import Document, Node, repair, squash

_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_BARE = re.compile(r"&(?![A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)")
_XML = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<[?!][^>]*>|<(/?)([^\s/>]+)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
_TAGS = re.compile(r"<[^>]*(?:>|\Z)")


class Element:
    __slots__ = ("name", "attributes", "children", "parts")

    def __init__(self, name: str, attributes: str):
        self.name, self.attributes = name, attributes
        self.children: list[Element] = []
        self.parts: list[str] = []

    def get(self, key: str) -> str:
        m = re.search(rf"""(?:^|\s){key}\s*=\s*(?:"([^"]*)"|'([^']*)')""", self.attributes)
        return decode_entities(m[1] if m[1] is not None else m[2]).strip() if m else ""

    def all(self, name: str) -> list[Element]:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if x.name == name:
                out.append(x)
            todo += reversed(x.children)
        return out

    def first(self, *names: str) -> Element | None:
        return next((c for c in self.children if c.name in names), None)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def decode_entities(text: str) -> str:
    """Numeric and named entities; what isn't one stays as it is."""
    if "&" not in text:
        return text
    return unescape(_NAMED.sub(lambda m: m[0] if m[1] + ";" in html5 else f"&amp;{m[1]};", _BARE.sub("&amp;", text)))


def xml(source: str) -> Element:
    """A tree of lower-case local names. Wrong end names, bare ampersands and unknown entities are borne; no angle bracket at all is an error."""
    root = Element("", "")
    stack = [root]
    at = 0
    for m in _XML.finditer(source):
        stack[-1].parts.append(decode_entities(source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1].parts.append(m[1])
        elif m[3]:
            name = m[3].rpartition(":")[2].lower()
            if m[2]:
                if any(x.name == name for x in stack[1:]):
                    while stack[-1].name != name:
                        stack.pop()
                    stack.pop()
                elif len(stack) > 1:
                    stack.pop()  # an end tag with another name ends what is open
            else:
                element = Element(name, m[4])
                stack[-1].children.append(element)
                if not m[4].rstrip().endswith("/"):
                    stack.append(element)
    if not root.children:
        raise ValueError("not XML")
    return root


def _bare(text: str) -> str:
    return squash(_TAGS.sub("", text))


def feed_items(source: str) -> list[dict[str, str | None]]:
    """Items of an RSS or Atom feed in order, those with a link: title, link, summary, published (as written)."""
    out = []
    root = xml(source)
    for item in root.all("item") or root.all("entry"):
        title, when = item.first("title"), item.first("pubdate", "published", "updated", "date")
        summary = item.first("description", "summary", "content")
        links = [c for c in item.children if c.name == "link"]
        addresses = [x.get("href") or squash(x.text) for x in links if x.get("rel") in ("", "alternate")] or [x.get("href") for x in links]
        link = next((a for a in addresses if a), "")
        if link:
            out.append({"title": _bare(title.text) if title else "", "link": link, "summary": _bare(summary.text) if summary else "", "published": squash(when.text) or None if when else None})
    return out


def sitemap(source: str) -> dict[str, list[str]]:
    """Page and child sitemap addresses of a sitemap file."""
    root = xml(source)
    found = {"urls": root.all("url"), "sitemaps": root.all("sitemap")}
    return {k: [a for x in v for loc in x.all("loc") if (a := squash(loc.text)).startswith("http")] for k, v in found.items()}


def arxiv(source: str) -> list[tuple[str, str, str]]:
    """Entries of an Atom answer: title, page address (https), authors with year and abstract."""
    out = []
    for entry in xml(source).all("entry"):
        links = [x.get("href") for x in entry.children if x.name == "link" and x.get("rel") == "alternate"]
        ident, title, told, when = (entry.first(n) for n in ("id", "title", "summary", "published"))
        url = next((a for a in links if a), squash(ident.text) if ident else "")
        if url:
            names = [squash(n.text) for a in entry.children if a.name == "author" for n in a.children if n.name == "name"]
            out.append((squash(title.text) if title else "", re.sub("^http:", "https:", url), scholarly(names, when.text.strip() if when else "", squash(told.text) if told else "")))
    return out


def scholarly(names: list[str], date: str, body: str) -> str:
    """``functions.text.scholarly_snippet`` in Python."""
    head = ", ".join(names[:3]) + (" et al." if len(names) > 3 else "")
    year = re.match("[0-9]*", date)[0]  # type: ignore[index]
    head += f" ({year})" if year else ""
    text = squash(head + (". " if head and body else "") + body)
    return text if len(text) <= 1200 else text[:1200] + "…"


def _classed(doc: Document, *names: str) -> list[Node]:
    return [x for x in doc.nodes if x.name and set((x.get("class") or "").split()) & set(names)]


def result_page(source: str) -> list[tuple[str, str, str]]:
    """Hits of an HTML result page of links ``result__a``, their redirects unwrapped."""
    out = []
    for a in _classed(Document(repair(source)), "result__a"):
        href = (a.get("href") or "").strip()
        wrapped = parse_qs(urlsplit(href).query.replace("+", "%2B")).get("uddg")
        url = wrapped[0] if wrapped else f"https:{href}" if href.startswith("//") else href
        if a.name != "a" or not url.startswith("http"):
            continue
        card = next((x for x in a.ancestors() if {"result", "result__body"} & set((x.get("class") or "").split())), None)
        told = next((x.inner_text() for x in (card.walk() if card else ()) if "result__snippet" in (x.get("class") or "").split()), "")
        out.append((a.inner_text(), url, told))
    if not out:
        raise ValueError("no results in the page")
    return out


def metasearch(source: str) -> list[tuple[str, str, str]]:
    """Hits of a metasearch answer: JSON, else its HTML page."""
    try:
        found = json.loads(source)
        return [(squash(r.get("title") or ""), r["url"], squash(r.get("content") or "")) for r in found["results"] if r.get("url")]
    except (ValueError, TypeError, KeyError, AttributeError):
        pass
    out = []
    for card in _classed(Document(repair(source)), "result"):
        anchors = [x for h in card.walk() if h.name in ("h3", "h4") for x in h.walk() if x.name == "a"] or [x for x in card.walk() if x.name == "a"]
        url = next((x.get("href") or "" for x in anchors), "")
        if url.startswith("http"):
            told = next((x.inner_text() for x in card.walk() if {"content", "result-content"} & set((x.get("class") or "").split())), "")
            out.append((anchors[0].inner_text(), url, told))
    return out


def index_page(source: str, url: str | None) -> list[tuple[str, str, str]]:
    """The entry links of a listing page."""
    from skein.html.extract import ExtractOptions, extract_one

    return [(x["text"], x["url"], x["snippet"]) for x in extract_one(source, url, ExtractOptions(index_mode="always"))["links"]]


def robots(source: str, agent: str) -> dict:
    """Rules, delay and sitemaps that hold for ``agent``; its own groups beat the wildcard's.

    A group is the agents named in a row and what follows them; names match by containment either way.
    """
    name = agent.lower()
    kinds = ("own", "any")
    rules: dict[str, list[tuple[bool, str]]] = {k: [] for k in kinds}
    delays: dict[str, float | None] = dict.fromkeys(kinds)
    sitemaps: list[str] = []
    group: set[str] = set()
    naming = False
    for line in source.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            group = group if naming else set()
            other = value.lower()
            if other == "*":
                group.add("any")
            elif other in name or name in other:
                group.add("own")
            naming = True
            continue
        naming = False
        if key == "sitemap":
            sitemaps.append(value)
        elif key == "allow" or (key == "disallow" and value):
            for k in group:
                rules[k].append((key == "allow", value))
        elif key == "crawl-delay":
            try:
                seconds = float(value)
            except ValueError:
                seconds = -1.0
            for k in group:
                delays[k] = seconds if 0 <= seconds < float("inf") else None
    kind = "own" if rules["own"] or delays["own"] is not None else "any"
    return {"rules": [{"allow": a, "pattern": p} for a, p in rules[kind]], "crawl_delay": delays[kind], "sitemaps": sitemaps}


_REFRESH = re.compile(r"<[^>]*http-equiv[^>]*>", re.I)
_LOCATION = re.compile(r"""location\.(?:replace\(|assign\(|href ?=)\s*(["'])(.*?)\1""", re.S)


def html_redirect(body: str | None, base: str) -> str | None:
    """Where a small page sends its reader at once: a refresh without delay or a script's location; never to itself."""
    if not body or len(body.encode("utf-8", "surrogatepass")) > 4096:
        return None
    target = None
    for tag in _REFRESH.findall(body):
        m = re.search(r"content\s*=\s*[\"']?[^0-9\"'>]*([0-9]*)[^>]*?url=\s*[\"']?([^\"'>]+)", tag, re.I)
        if "refresh" in tag.lower() and m and int(m[1] or 0) == 0 and m[2].strip():
            target = m[2]
            break
    if target is None:
        target = next((m[2] for m in _LOCATION.finditer(body) if m[2].startswith(("http", "/"))), None)
    if target is None:
        return None
    try:
        url = urljoin(base, target.strip().strip("\"'"))
    except ValueError:
        return None
    return url if url.startswith(("http://", "https://")) and url.rstrip("/") != base.rstrip("/") else None


# Encodings tried for a top-level domain when nothing else tells.
_BY_DOMAIN = {"kr": ("cp949",), "jp": ("shift_jis", "euc_jp"), "cn": ("gb18030",), "tw": ("big5",), "ru": ("cp1251",), "th": ("cp874",)}
_DECLARED = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)


def decode(body: bytes, content_type: str | None, url: str | None) -> str:
    """By the header's charset, the first 4096 bytes' declaration, as UTF-8 (a torn end is borne), else by top-level domain."""
    named = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", content_type or "", re.I)
    declared = _DECLARED.search(body[:4096])
    for name in (named[1] if named else "", declared[1].decode("ascii") if declared else ""):
        try:
            if name:
                return body.decode(name, "replace")
        except LookupError:
            continue
    for cut in range(4):
        try:
            return body[: len(body) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
    host = urlsplit(url or "").hostname or ""
    for name in (*_BY_DOMAIN.get(host.rpartition(".")[2], ()), "cp1252"):
        try:
            return body.decode(name)
        except UnicodeDecodeError:
            continue
    return body.decode("latin-1")
