"""Problem 6 by density alone: two passes of block rules over stop-word density, length and link density.

The first pass calls a block good, bad, near good or short; the second lets what is open inherit from the
nearest blocks that are decided, as near-good and short blocks between good ones are main body and others
aren't. Headings follow the next block that isn't short. Where a block stands, its class names and what its words
mean play no part: this is the method itself, against which ``main_body`` states what it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.blocks import Block, parse, squeeze
from skein.llm.main_body import FURNITURE, HEADINGS, MAIN, fingerprint, match

#: Characters under which a block is short, and from which a dense one is good by itself.
SHORT, LONG = 70, 200
#: Densities of stop words from which a block may be, and is, running text; share of linked text from which a block is bad.
LOW, HIGH, LINKED = 0.12, 0.22, 0.2
GOOD, BAD, NEAR, OPEN = range(4)

# Function words of the languages served; characters where words aren't separated.
STOP_WORDS = {
    "en": "the of and to a in is that for it on with",
    "de": "der die und in den von zu das mit ist nicht eine",
    "fr": "de la le et les des en un une du que pour",
    "es": "de la que el en y los se las un por con",
    "pt": "de a o que e do da em um os para uma",
    "ru": "и в не на что с по как к из за для",
    "ar": "في من على أن إلى التي عن مع هذا هذه ما لا",
    "hi": "के में की है और को से का कि पर एक नहीं",
    "ko": "이 그 및 수 있다 하는 것 등 한 더 또 있는",
    "ja": "の に は を た が で て と し",
    "zh": "的 了 是 在 和 有 不 这 一 为",
    "th": "การ ที่ และ ใน ของ เป็น ได้ ว่า มี ให้",
}
_SPACED = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items() if lang not in ("ja", "zh", "th")}
_DENSE = {lang: tuple(STOP_WORDS[lang].split()) for lang in ("ja", "zh", "th")}
_DENSE_RUN = re.compile("[฀-๿぀-ヿ㐀-鿿]+")
_WORD = re.compile(r"[^\W\d_]+[̀-ͯऀ-ॿ]*")


def stop_density(text: str) -> float:
    """Share of a text that is stop words of the language they fit best; in scripts without spaces the characters count."""
    low = text.lower()
    dense = "".join(_DENSE_RUN.findall(low))
    if 2 * len(dense) > len(low.replace(" ", "")):
        return max(sum(dense.count(w) * len(w) for w in words) for words in _DENSE.values()) / len(dense)
    words = low.split()
    bare = [w.strip(".,;:!?()[]\"'«»“”„…،؟।") for w in words]
    return max(sum(w in stop for w in bare) for stop in _SPACED.values()) / len(words) if words else 0.0


def first_pass(block: Block) -> int:
    """A block's class by itself."""
    if block.link_share > LINKED:
        return BAD
    n = len(block.text) * (2 if 2 * len("".join(_DENSE_RUN.findall(block.text))) > len(block.text) else 1)
    if n < SHORT:
        return OPEN
    density = stop_density(block.text)
    if density >= HIGH:
        return GOOD if n > LONG else NEAR
    return NEAR if density >= LOW else BAD


def second_pass(classes: list[int], headings: list[bool]) -> list[int]:
    """GOOD or BAD for every block: what is open goes with its nearest decided neighbours."""
    n = len(classes)
    before, after = [BAD] * n, [BAD] * n
    seen = BAD
    for i in range(n):
        before[i] = seen
        seen = classes[i] if classes[i] in (GOOD, BAD) else seen
    seen = BAD
    for i in range(n - 1, -1, -1):
        after[i] = seen
        seen = classes[i] if classes[i] in (GOOD, BAD) else seen
    # A near-good block is good beside a good one; a short one only between two, where near-good ones count once they are.
    out = [c if c in (GOOD, BAD) else GOOD if c == NEAR and GOOD in (before[i], after[i]) else BAD if c == NEAR else OPEN for i, c in enumerate(classes)]
    for order in (range(n), range(n - 1, -1, -1)):
        seen = BAD
        sides = before if order.step > 0 else after
        for i in order:
            sides[i] = seen
            seen = out[i] if out[i] != OPEN else seen
    return [c if c != OPEN else GOOD if after[i] == GOOD and (headings[i] or before[i] == GOOD) else BAD for i, c in enumerate(out)]


def labels_of(blocks: list[Block]) -> list[int]:
    found = second_pass([first_pass(b) for b in blocks], [b.tag in HEADINGS for b in blocks])
    return [MAIN if x == GOOD else FURNITURE for x in found]


def other_units(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """(source_id, unit_idx): units that aren't main body by density.

    Every unit of every article is judged as the page block with its text; one that no block has by itself.
    Repeated rows count once; an article without text has no units.
    """
    kind = pa.schema([("page_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32()))])
    ints = pa.list_(pa.int32())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(body).blocks for body in batch.column(1).to_pylist()]
            keys = [[fingerprint(b.key) for b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, kind[1].type), pa.array([labels_of(x) for x in found], kind[2].type)], schema=kind)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, keys, labels in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = text.split("\n\n") if text else []
                found = match([fingerprint(squeeze(u)) for u in own], keys or [], labels or [])
                alone = [Block("", u, "p", 0, 0.0, "") for u in own]
                out.append([i for i, x in enumerate(found) if (first_pass(alone[i]) in (BAD, OPEN) if x is None else x != MAIN)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, ints)], names=["source_id", "other"])

    done = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "body").mapInArrow(blocks, "page_id long, keys array<long>, labels array<int>")
    best = F.max_by(F.struct("keys", "labels"), F.struct(F.size("keys"), F.hash("keys", "labels")))
    each = done.groupBy("page_id").agg(best.alias("p")).select(F.col("page_id").alias("source_id"), "p.*")
    own = articles.where("source_id is not null").select(F.col("source_id").cast("long").alias("source_id"), "text").dropDuplicates(["source_id"])
    rows = own.join(each, "source_id", "left").select("source_id", "text", "keys", "labels").mapInArrow(units, "source_id long, other array<int>")
    return rows.select("source_id", F.explode("other").alias("unit_idx"))
