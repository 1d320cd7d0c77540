"""Pages whose content is their links."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import NamedTuple
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

from skein.functions.url import TRACKING
from skein.html.denoise import DenoiseConfig, is_noise
from skein.html.markdown import Unit
from skein.html.tree import BLOCKS, HEADINGS, Document, Node, squash
from skein.operators.slim import estimate

MIN_LINKS, TITULAR, COVERAGE = 5, 0.35, 0.25
MIN_CHARS, SINGLE_WORD, MAX_CHARS, SNIPPET = 8, 12, 200, 200
# Anchor texts that steer, and words that count things beside a headline.
CONTROLS = frozenset(
    "home|about|contact|login|log in|sign in|sign up|register|search|menu|more|read more|next|previous|prev|back|top|share|subscribe|newsletter|privacy|"
    "terms|cookies|settings|help|support|faq|rss|skip to content|advertisement|댓글|로그인|회원가입|더보기|구독".split("|")
)
COUNTED = frozenset(
    "comment comments point points vote votes reply replies view views second seconds minute minutes hour hours day days week weeks month months year years "
    "ago 분 시간 일 개".split()
)


class Link(NamedTuple):
    text: str
    url: str
    snippet: str
    heading_path: list[str]


def url_key(url: str) -> str | None:
    """T16 in Python: what ``functions.url.canonical_url`` gives."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not host:
        return None
    while host.startswith("www."):
        host = host[4:]
    query = sorted(p for p in parse_qsl(parts.query, keep_blank_values=True) if p[0] not in TRACKING)
    return host + parts.path.rstrip("/") + (f"?{urlencode(query)}" if query else "")


def is_headline(text: str) -> bool:
    """Whether an anchor's text could be a headline."""
    text = text.strip()
    words = text.lower().split()
    if not MIN_CHARS <= len(text) <= MAX_CHARS or (len(text) < SINGLE_WORD and len(words) < 2):
        return False
    if not any(c.isalpha() for c in text) or text.lower() in CONTROLS:
        return False
    if len(words) == 1 and "." in words[0]:
        return False  # a domain or file name
    bare = [re.sub(r"^\W+|\W+$", "", w) for w in words]
    counts = len(words) <= 3 and re.fullmatch(r"[0-9.,]*[0-9][0-9.,]*", bare[0]) and any(w in COUNTED for w in bare[1:])
    return not counts


def is_titular(anchor: Node) -> bool:
    """Whether a link titles its block: it holds or stands in a heading, or is a good part of the block's text."""
    if any(x.name in HEADINGS for x in anchor.walk() if x is not anchor):
        return True
    for up in anchor.ancestors():
        if up.name in HEADINGS:
            return True
        if up.name in BLOCKS:
            return not up.text_len or anchor.text_len >= TITULAR * up.text_len
    return True


def _headed_tables(doc: Document) -> set[int]:
    """Ids of nodes inside tables with header cells: data, not layout."""
    out: set[int] = set()
    for node in doc.nodes:
        if node.name == "table" and any(x.name == "th" for x in node.walk()):
            out.update(id(x) for x in node.walk())
    return out


def could_be_listing(doc: Document, article_chars: int) -> bool:
    """An upper bound from measures at hand: pages it turns down can't be listings."""
    skip = _headed_tables(doc)
    sizes = [x.text_len for x in doc.nodes if x.name == "a" and MIN_CHARS <= x.text_len <= MAX_CHARS and id(x) not in skip and is_titular(x)]
    return len(sizes) >= MIN_LINKS and (not article_chars or sum(sizes) > COVERAGE * article_chars)


def harvest(doc: Document, base: str | None, cfg: DenoiseConfig) -> list[Link]:
    """Entry links in order, each address once; a first sight in the furniture counts."""
    cfg = replace(cfg, max_link_density=1.0, min_text_ratio=0.0)
    skip = _headed_tables(doc)
    seen = {url_key(base)} if base else set()
    trail: list[tuple[int, str, Node]] = []
    out: list[Link] = []
    for node in doc.nodes:
        if node.name in HEADINGS:
            title = node.inner_text()
            if title:
                level = HEADINGS.index(node.name)
                while trail and trail[-1][0] >= level:
                    trail.pop()
                trail.append((level, title, node))
        elif node.name == "a" and id(node) not in skip:
            text = node.inner_text()
            url = _target(node.get("href"), base)
            key = url_key(url) if url else None
            if not is_headline(text) or key is None or key in seen:
                continue
            seen.add(key)
            above = list(node.ancestors(32))
            if is_titular(node) and not any(is_noise(doc, x, cfg) for x in above):
                holders = {id(x) for x in node.ancestors()}
                out.append(Link(text, url, _snippet(node, text), [t for _, t, h in trail if id(h) not in holders]))  # type: ignore[arg-type]
    return out


def _target(href: str | None, base: str | None) -> str | None:
    href = (href or "").strip()
    if not href or href.startswith(("#", "javascript:")):
        return None
    try:
        url = urljoin(base, href) if base else href
    except ValueError:
        return None
    return url if url.lower().startswith(("http://", "https://")) else None


def _snippet(anchor: Node, text: str) -> str:
    """The text beside a link in its card: the nearest ancestor with some more text, but not a whole section."""
    own = anchor.text_len
    for card in anchor.ancestors(4):
        if own + 20 < card.text_len < max(10 * own, own + 600):
            rest = squash(card.inner_text().replace(text, " "))
            return rest[:SNIPPET] if len(rest) >= 20 else ""
    return ""


def is_listing(links: list[Link], article_chars: int) -> bool:
    return len(links) >= MIN_LINKS and (not article_chars or sum(len(x.text) for x in links) > COVERAGE * article_chars)


def listing_units(links: list[Link]) -> list[Unit]:
    """One list item per link, and a heading wherever the section changes."""
    out: list[Unit] = []
    path: list[str] = []
    for link in links:
        if link.heading_path and link.heading_path != path:
            path = link.heading_path
            head = f"## {path[-1]}"
            out.append(Unit("heading", 2, path[-1], head, path[:-1], estimate(head)))
        tail = f" — {link.snippet}" if link.snippet else ""
        line = f"- [{link.text}]({link.url}){tail}"
        out.append(Unit("list_item", 0, link.text + tail, line, link.heading_path, estimate(line)))
    return out
