"""What a page says about itself."""

from __future__ import annotations

import json
from typing import Any

from skein.functions.text import TITLE_SEPARATORS
from skein.html.tree import Document, squash

FIELDS = ("title", "description", "byline", "published", "language", "canonical", "site_name")
# Names of meta elements by field; the first met wins but for title and site name.
NAMES = {
    "og:title": "title",
    "twitter:title": "title",
    "og:description": "description",
    "twitter:description": "description",
    "description": "description",
    "og:site_name": "site_name",
    "og:locale": "language",
    "og:url": "canonical",
    "author": "byline",
    "article:author": "byline",
    "dc.creator": "byline",
    "citation_author": "byline",
    "byl": "byline",
    "article:published_time": "published",
    "datepublished": "published",
    "dc.date": "published",
    "date": "published",
    "citation_publication_date": "published",
    "pubdate": "published",
}


def extract_meta(doc: Document) -> dict[str, str | None]:
    """Every field, null where the page is silent."""
    found: dict[str, str | None] = dict.fromkeys(FIELDS)

    def fill(field: str, value: Any, last: bool = False) -> None:
        clean = squash(value) if isinstance(value, str) else ""
        if clean and (last or found[field] is None):
            found[field] = clean

    for node in doc.nodes:
        if node.name == "html":
            fill("language", node.get("lang"))
        elif node.name == "title":
            fill("title", node.raw_text())
        elif node.name == "link" and (node.get("rel") or "").strip() == "canonical":
            fill("canonical", node.get("href"))
        elif node.name == "meta":
            key = node.get("property") or node.get("name") or node.get("itemprop") or ""
            field = NAMES.get(key.strip().lower())
            if field:
                value = node.get("content") or ""
                fill(field, value.replace("_", "-") if field == "language" else value, last=field in ("title", "site_name"))
        elif node.name == "script" and node.get("type") == "application/ld+json":
            _linked_data(node.raw_text(), fill)
    title, site = found["title"], found["site_name"]
    if title and site:
        for separator in TITLE_SEPARATORS:
            head = title.removesuffix(separator + site).strip()
            if title.endswith(separator + site) and len(head) >= 2:
                found["title"] = head
                break
    return found


def _linked_data(source: str, fill: Any) -> None:
    """Fields of JSON-LD nodes, wherever they nest; fills gaps only."""
    try:
        todo = [json.loads(source)]
    except (ValueError, RecursionError):
        return
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            if "@graph" in node:
                todo.append(node["@graph"])
            for key, field in (("headline", "title"), ("datePublished", "published"), ("description", "description")):
                fill(field, node.get(key))
            author = node.get("author")
            people = author if isinstance(author, list) else [author]
            names = [p.get("name") if isinstance(p, dict) else p for p in people]
            fill("byline", ", ".join(x for x in names if isinstance(x, str)))
