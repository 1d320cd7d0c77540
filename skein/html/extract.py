"""Pages to articles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skein.html.denoise import DenoiseConfig, content_root
from skein.html.listing import could_be_listing, harvest, is_listing, listing_units
from skein.html.markdown import RenderOptions, Writer
from skein.html.meta import FIELDS, extract_meta
from skein.html.tree import Document, repair


@dataclass(frozen=True)
class ExtractOptions:
    denoise: DenoiseConfig = field(default_factory=DenoiseConfig)
    render: RenderOptions = field(default_factory=RenderOptions)
    index_mode: str = "auto"  # auto, never or always
    min_content_chars: int = 200
    compare_gap: float = 1.2
    max_bytes: int = 8 << 20

    def __post_init__(self) -> None:
        if self.index_mode not in ("auto", "never", "always"):
            raise ValueError("index_mode must be auto, never or always")


UNIT = "struct<kind:string,level:int,text:string,markdown:string,heading_path:array<string>,position:int,tokens:int>"
LINK = "struct<text:string,url:string,snippet:string,heading_path:array<string>>"
ARTICLE = (
    f"struct<kind:string,meta:struct<{','.join(f'{f}:string' for f in FIELDS)}>,markdown:string,text:string,units:array<{UNIT}>,links:array<{LINK}>,"
    "stats:struct<nodes_visited:long,nodes_dropped:long,html_bytes:long,markdown_bytes:long>>"
)


def extract_one(source: str, url: str | None, options: ExtractOptions = ExtractOptions()) -> dict:
    """The article of a page as nested values; empty for a page without content."""
    doc = Document(repair(source))
    meta = extract_meta(doc)
    base = url or meta["canonical"]
    body = next((x for x in doc.nodes if x.name == "body"), None)
    if body is None or doc.root.text_len > 2 * body.text_len:  # text stranded outside the body
        body = doc.root
    root = content_root(doc, options.denoise) or body

    def written(top) -> Writer:
        writer = Writer(doc, options.denoise, options.render, base)
        writer.walk(top, judge=False)
        return writer

    writer = written(root)
    if root is not body and (writer.length < options.min_content_chars or body.text_len > options.compare_gap * root.text_len):
        other = written(body)
        writer = other if other.length > writer.length else writer
    units, links, kind = writer.units, [], "article"
    if options.index_mode != "never" and could_be_listing(doc, writer.length):
        found = harvest(doc, base, options.denoise)
        if is_listing(found, writer.length):
            kind, links, units = "index", found, listing_units(found)
        elif options.index_mode == "always":
            links = found
    markdown = "\n\n".join(u.markdown for u in units)
    outside = len(doc.nodes) - sum(1 for _ in root.walk())
    size = len(source.encode("utf-8", "surrogatepass"))
    return {
        "kind": kind,
        "meta": meta,
        "markdown": markdown,
        "text": "\n".join(u.text for u in units),
        "units": [{**u._asdict(), "position": i} for i, u in enumerate(units)],
        "links": [x._asdict() for x in links],
        "stats": {
            "nodes_visited": len(doc.nodes),
            "nodes_dropped": min(len(doc.nodes), writer.dropped + outside),
            "html_bytes": size,
            "markdown_bytes": len(markdown.encode("utf-8", "surrogatepass")),
        },
    }


def extract(pages: DataFrame, options: ExtractOptions = ExtractOptions(), key: str = "page_id", url: str = "final_url", html: str = "body") -> DataFrame:
    """(key, url, article, error) of every row: one Arrow pass, nothing is shuffled.

    ``error`` is a struct (kind, message) instead of a failed job: empty and oversized pages have one
    and a null article.
    """
    schema = StructType.fromDDL(f"key long, url string, article {ARTICLE}, error struct<kind:string,message:string>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, u, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                article, error = None, None
                if not source:
                    error = {"kind": "ExtractError", "message": "no content extracted"}
                elif 4 * len(source) > options.max_bytes and len(source.encode("utf-8", "surrogatepass")) > options.max_bytes:
                    error = {"kind": "NetworkError", "message": "body too large"}
                else:
                    try:
                        article = extract_one(source, u, options)
                        if not article["units"]:
                            error = {"kind": "ExtractError", "message": "no content extracted"}
                    except (ValueError, RecursionError) as e:
                        error = {"kind": "ExtractError", "message": str(e)}
                rows.append({"key": k, "url": u, "article": article, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def units_of(articles: DataFrame, key: str = "page_id", *more: str) -> DataFrame:
    """(source_id, unit_idx, kind, level, text, markdown, heading_path, tokens) of extracted articles, and the columns named in ``more``."""
    return articles.select(F.col(key).alias("source_id"), *more, F.posexplode("article.units").alias("unit_idx", "u")).select(
        "source_id", "unit_idx", "u.kind", "u.level", "u.text", "u.markdown", "u.heading_path", "u.tokens", *more
    )


def links_of(articles: DataFrame, key: str = "page_id") -> DataFrame:
    """(source_id, pos, text, url, snippet, heading_path) of extracted articles."""
    return articles.select(F.col(key).alias("source_id"), F.posexplode("article.links").alias("pos", "x")).select("source_id", "pos", "x.*")
