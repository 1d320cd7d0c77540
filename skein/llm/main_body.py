"""Problem 6: the main body of each page.

Two passes of block rules. The first decides a block from where it stands (the container that holds
the page's prose), its link density, its marks, its length, and its word evidence: stop-word density
generalized to log-odds of words between prose and furniture, learned from the pages themselves. The
second lets the blocks left open inherit the label of the nearest decided neighbour.

The word evidence is counted over all pages, and so are the lines that come back on a site's pages; the
rules then run on every page. Pages shrink to (hash, label) arrays before the one shuffle, which brings them
together with the articles' blocks. ``density`` has the rules without places and words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.durable import cut, drop
from skein.llm.blocks import Page, parse, squeeze
from skein.llm.repeated_lines import site_of
from skein.llm.words import features

#: Words with odds and paths of main containers that the model holds at most, the commonest.
MAX_WORDS, MAX_ROOTS = 60_000, 20_000
#: Words that a task counts before it passes them on.
HELD_WORDS = 200_000
LONG, SURE = 90, 2.0
#: Labels: main body; furniture; furniture only by its words; code of the main body; a link in the main
#: container, which is main body on index pages and furniture on others; heading and table of the main body.
MAIN, FURNITURE, WORDED, VERBATIM, LINK, HEADING, TABLE = 0, 1, 2, 3, 4, 5, 6
_LETTERS = re.compile(r"[\W\d_]+")

# Class and id words of page furniture, and tags that are furniture by definition.
NOISE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|author|banner|breadcrumbs?|byline|comments?|consent|cookies?|copyright|credits?|date|disclaimer|"
    r"footer|header|imprint|legal|menu|meta|nav\w*|newsletter|pager|promo\w*|published|rail|related|share\w*|sharing|sidebar|signup|"
    r"social|sponsor\w*|stamp|subscribe|tags?|talk|time|toolbar|widget|writer)(?:[-_\s]|$)"
)
CHROME = frozenset("nav footer aside header menu form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SOLID = HEADINGS | {"pre", "table", "blockquote"}


class Weights(NamedTuple):
    words: dict[str, float]  # log-odds of furniture
    roots: dict[str, int]  # paths of containers with a first h1: pages seen with it


NO_WEIGHTS = Weights({}, {})


def fingerprint(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def evidence(text: str, weights: Weights) -> float:
    """Log-odds that a text is furniture."""
    get = weights.words.get
    return sum(get(f, 0.0) for f in features(text))


def root_of(page: Page, weights: Weights) -> int:
    """The container that holds the main body.

    The first h1's; without one, the container with the path that most often holds the h1 on other
    pages; else an article or main element; else the container with most text that is neither
    furniture by its words nor link.
    """
    chrome = [False] * len(page.parents)
    for i in range(1, len(page.parents)):
        chrome[i] = chrome[page.parents[i]] or page.tags[i] in CHROME
    for b in page.blocks:
        if b.tag == "h1" and not chrome[b.node]:
            return b.node
    holders = dict.fromkeys(b.node for b in page.blocks if not chrome[b.node] and page.tags[b.node] != "noscript")
    known = max(holders, key=lambda k: weights.roots.get(page.paths[k], 0), default=0)
    if known and weights.roots.get(page.paths[known], 0):
        return known
    for name in ("article", "main"):
        for k in holders:
            if page.tags[k] == name:
                return k
    score: dict[int, float] = {}
    for b in page.blocks:
        if chrome[b.node] or b.link_share > 0.6:
            value = -20.0
        else:
            value = min(len(b.text), 400) + 20.0
            if evidence(b.text, weights) > 0:
                value = -value
        score[b.node] = score.get(b.node, 0.0) + value
    return max(score, key=lambda k: (score[k], -k), default=0)


def inside(page: Page, root: int) -> list[bool]:
    """For every container whether it lies in ``root``."""
    out = [False] * len(page.parents)
    for i in range(len(page.parents)):
        out[i] = i == root or (i > 0 and out[page.parents[i]])
    return out


def label(page: Page, weights: Weights) -> list[int]:
    """A label per block."""
    root = root_of(page, weights)
    within = inside(page, root)
    content = page.tags[root] != "noscript"
    out: list[int | None] = []
    for b in page.blocks:
        if not within[b.node] or (content and page.tags[b.node] == "noscript") or any_chrome(page, b.node, root):
            out.append(FURNITURE)
        elif b.marks and len(b.text) < 2 * LONG and (NOISE.search(b.marks) or evidence(b.text, weights) > SURE):
            out.append(FURNITURE)
        elif b.tag in SOLID:
            out.append(VERBATIM if b.tag == "pre" else TABLE if b.tag == "table" else HEADING if b.tag in HEADINGS else MAIN)
        elif b.link_share > 0.6:
            out.append(LINK)
        elif len(b.text) >= 2 * LONG:
            out.append(MAIN)
        else:
            words = evidence(b.text, weights)
            out.append(WORDED if words > SURE else MAIN if words < -SURE or (len(b.text) >= LONG and words <= 0) else None)
    if None in out:
        decided = [i for i, x in enumerate(out) if x is not None and within[page.blocks[i].node] and x not in (VERBATIM, TABLE)]
        near = nearest(decided, len(out))
        for i, x in enumerate(out):
            if x is None:
                out[i] = MAIN if near[i] < 0 or out[near[i]] in (MAIN, LINK, HEADING) else WORDED
    return out  # type: ignore[return-value]


def nearest(decided: list[int], n: int) -> list[int]:
    """For every position the nearest of ``decided`` (ascending; the earlier one of two), -1 if there is none."""
    out = [-1] * n
    for i in decided:
        out[i] = i
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        last = i if out[i] >= 0 else last
        before[i] = last
    last = -1
    for i in range(n - 1, -1, -1):
        last = i if out[i] >= 0 else last
        after[i] = last
    for i in range(n):
        a, b = before[i], after[i]
        out[i] = b if a < 0 else a if b < 0 or i - a <= b - i else b
    return out


def any_chrome(page: Page, node: int, root: int) -> bool:
    while node != root and node:
        if page.tags[node] in CHROME:
            return True
        node = page.parents[node]
    return False


ROOT, WORD, TOTAL, LINE = range(4)  # kinds of rows of ``seen_blocks``


def seen_blocks(pages: DataFrame) -> DataFrame:
    """(kind, name, site, head, line, side0, side1): what all pages with an ``h1`` show of words by side.

    ROOT rows count paths of main containers. WORD rows count, for each word, the blocks that are main body for
    sure (long text and headings inside the container) and furniture for sure (short text outside it and
    marked text in it), TOTAL rows the blocks; all three are summed in each task first. LINE rows are the
    short blocks in the container that are neither: ``name`` is the text, ``line`` a hash of its letters, ``head`` one
    of the page's title.
    """
    kind = pa.schema([("kind", pa.int32()), ("name", pa.string()), ("site", pa.string()), ("head", pa.int64()), ("line", pa.int64()), ("side0", pa.int64()), ("side1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        totals = [0, 0]
        roots: Counter = Counter()

        def flush() -> list[tuple]:
            out = [(WORD, w, None, None, None, sums[0][w], sums[1][w]) for w in sums[0].keys() | sums[1].keys()]
            out += [(ROOT, p, None, None, None, n, 0) for p, n in roots.items()]
            out.append((TOTAL, None, None, None, None, *totals))
            for held in (*sums, roots):
                held.clear()
            totals[:] = [0, 0]
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        for batch in batches:
            rows = []
            for site, body in zip(*(batch.column(i).to_pylist() for i in range(2))):
                page = parse(body)
                title = next((b.key for b in page.blocks if b.tag == "h1"), None)
                if title is None:
                    continue
                head = fingerprint(title.lower())
                root = root_of(page, NO_WEIGHTS)
                roots[page.paths[root]] += 1
                within = inside(page, root)
                for b in page.blocks:
                    short = len(b.text) < 2 * LONG
                    if not within[b.node]:
                        side = 1 if b.link_share <= 0.6 and short else None
                    elif b.marks and short and NOISE.search(b.marks):
                        side = 1
                    elif b.tag in HEADINGS or (len(b.text) >= LONG and b.tag not in ("pre", "table")):
                        side = 0
                    else:
                        side = None
                        letters = _LETTERS.sub("", b.text.lower()) if b.tag not in SOLID and b.link_share <= 0.6 else ""
                        if letters:
                            rows.append((LINE, b.text, site, head, fingerprint(letters), 0, 0))
                    if side is not None:
                        sums[side].update(features(b.text))
                        totals[side] += 1
            if len(sums[0]) + len(sums[1]) > HELD_WORDS:
                rows += flush()
            yield batch_of(rows)
        yield batch_of(flush())

    own = pages.where("body is not null").select(F.coalesce(site_of(F.col("final_url")), F.lit("")).alias("site"), "body")
    return own.mapInArrow(run, "kind int, name string, site string, head long, line long, side0 long, side1 long")


def learn(pages: DataFrame) -> Weights:
    """Word evidence and container paths, counted over all pages.

    Furniture: text outside the main container, marked text in it, and short lines in it that come
    back on pages of their site with three or more titles (copies of a page have one). Main: long text and headings in it. Other short text is labelled by the evidence so far, and
    the evidence is counted again with it, twice. What reaches the driver are the MAX_WORDS commonest words and the
    MAX_ROOTS commonest paths. Of repeated rows of a page each counts.
    """
    seen = cut(seen_blocks(pages))
    lines = seen.where(F.col("kind") == LINE).groupBy("name", "site", "line", "head").agg(F.count("*").alias("n"))
    often = lines.groupBy("site", "line").agg(F.countDistinct("head").alias("heads")).where("heads >= 3").select("site", "line", F.lit(True).alias("hit"))
    texts = cut(lines.join(often, ["site", "line"], "left").groupBy("name", F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.sum("n").alias("n")))
    roots = seen.where(F.col("kind") == ROOT).groupBy("name").agg(F.sum("side0").alias("n")).orderBy(F.desc("n"), "name").limit(MAX_ROOTS).collect()
    sure = cut(seen.where(F.col("kind").isin(WORD, TOTAL)).groupBy("name").agg(F.sum("side0").alias("side0"), F.sum("side1").alias("side1")))
    weights: dict[str, float] = {}
    for turn in range(3):
        both = sure.unionByName(_judged_words(texts, weights, turn == 0)).groupBy("name").agg(F.sum("side0").alias("side0"), F.sum("side1").alias("side1"))
        total = F.col("side0") + F.col("side1")
        kept = both.where((total >= 3) | F.col("name").isNull()).orderBy(F.col("name").isNotNull(), F.desc(total), "name").limit(MAX_WORDS + 1).collect()
        m0, m1 = next(((r.side0 + 1.0, r.side1 + 1.0) for r in kept if r.name is None), (1.0, 1.0))
        weights = {
            r.name: math.log((r.side1 + 0.1) / (m1 + 0.2)) - math.log((r.side0 + 0.1) / (m0 + 0.2))
            for r in kept
            if r.name is not None
        }
    drop(seen, texts, sure)
    return Weights(weights, {r.name: r.n for r in roots})


def _judged_words(texts: DataFrame, weights: dict[str, float], first: bool) -> DataFrame:
    """(name, side0, side1) of the words of ``texts`` (name, hit, n), and of the blocks under a null name: furniture where ``hit``, else by the evidence so far."""
    kind = pa.schema([("name", pa.string()), ("side0", pa.int64()), ("side1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[w] for w in names], pa.int64()) for s in sums)], schema=kind)
            for s in sums:
                s.clear()
            return out

        get = weights.get
        for batch in batches:
            for text, hit, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = features(text)
                value = SURE + 1 if hit else sum(get(f, 0.0) for f in found)
                if abs(value) > SURE:
                    side = sums[value > 0]
                    for f in found:
                        side[f] += n
                    side[None] += n
            if len(sums[0]) + len(sums[1]) > HELD_WORDS:
                yield flush()
        yield flush()

    own = texts.where("hit") if first else texts
    return own.select("name", "hit", "n").mapInArrow(run, "name string, side0 long, side1 long")


def page_labels(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, keys array<long>, labels array<int>): fingerprint and label of each block of each distinct page."""
    schema = "page_id long, keys array<long>, labels array<int>"
    kind = pa.schema([("page_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels = [], []
            for body in batch.column(1).to_pylist():
                page = parse(body)
                keys.append([fingerprint(b.key) for b in page.blocks])
                labels.append(label(page, weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, kind[1].type), pa.array(labels, kind[2].type)], schema=kind)

    done = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "body").mapInArrow(run, schema)
    # Equal rows give equal arrays; of unequal rows with one id the one with most blocks stays.
    best = F.max_by(F.struct("keys", "labels"), F.struct(F.size("keys"), F.hash("keys", "labels")))
    return done.groupBy("page_id").agg(best.alias("p")).select("page_id", "p.*")


def match(units: list[int], keys: list[int], labels: list[int]) -> list[int | None]:
    """A label for each unit: that of the page block with its fingerprint, taken in order where one repeats."""
    where: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        where.setdefault(k, []).append(i)
    out: list[int | None] = []
    last = -1
    for u in units:
        at = where.get(u)
        if not at:
            out.append(None)
            continue
        i = at[0] if len(at) == 1 else next((j for j in at if j > last), at[0])
        last = i if i > last else last
        out.append(labels[i])
    return out


def settle(found: list[int | None], texts: list[str], index: bool, weights: Weights) -> list[int]:
    """Final labels without LINK and gaps.

    A unit that no page block has is furniture if other units have one in the main container (the
    extraction took it from elsewhere); in an article without its page it is judged by its words, or
    like the nearest unit that is.
    """
    found = [None if x is None else (MAIN if index else FURNITURE) if x == LINK else MAIN if x == HEADING else x for x in found]
    if None not in found:
        return found  # type: ignore[return-value]
    if any(x is not None and x != FURNITURE for x in found):
        return [FURNITURE if x is None else x for x in found]
    words = [evidence(t, weights) for t in texts]
    found = [x if x is not None else WORDED if w > SURE else MAIN if w < -SURE or len(t) >= 2 * LONG else None for x, w, t in zip(found, words, texts)]
    near = nearest([i for i, x in enumerate(found) if x is not None], len(found))
    return [MAIN if x is None and near[i] < 0 else found[near[i]] if x is None else x for i, x in enumerate(found)]  # type: ignore[misc]
