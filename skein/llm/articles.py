"""Articles brought together with the labels of their pages' blocks: what problems 2, 3, 6 and 7 share."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import main_body, residue
from skein.llm.blocks import squeeze
from skein.llm.main_body import MAIN, TABLE, VERBATIM, Weights, fingerprint, match, page_labels, settle


class Models(NamedTuple):
    weights: Weights
    judge: residue.Judge


def fit(pages: DataFrame) -> Models:
    """The words and places of all pages, and the passages of a bounded sample of them (residue.SAMPLE_RECORDS and TRUSTED_RECORDS)."""
    weights = main_body.learn(pages)
    return Models(weights, residue.learn(residue.sample_records(pages), weights))


def judge(text: str | None, index: bool, keys: list[int] | None, labels: list[int] | None, models: Models) -> tuple[list[str], list[int], bool, list[int]]:
    """An article's units, their labels (main_body's), whether it is a residue case, and its units' residue classes.

    Units that are residue of a case count as main body.
    """
    units = (text or "").split("\n\n") if text else []
    prints = [fingerprint(squeeze(u.split(" — ")[0] if index and " — " in u else u)) for u in units]
    found = match(prints, keys or [], labels or [])
    final = settle(found, units, index, models.weights)
    if index:  # an entry is its headline and what follows it; a whole text that contains the dash comes first
        whole = match([fingerprint(squeeze(u)) for u in units], keys or [], labels or [])
        final = [f if w is None or w == main_body.LINK else MAIN if w == main_body.HEADING else w for f, w in zip(final, whole)]
    headed = any(x == main_body.HEADING and residue.is_head(u) for u, x in zip(units, found))
    case, classes = models.judge.record(units, final, headed)
    if case:
        final = [MAIN if c else x for x, c in zip(final, classes)]
    return units, final, case, classes


def judged(pages: DataFrame, articles: DataFrame, models: Models, with_body: bool = False) -> DataFrame:
    """One row per article: source_id, case boolean, main array<int>, other array<int>, residue array<int> and, if asked for, body.

    ``main`` and ``other`` are the unit indexes inside and outside the main body, ``residue`` those of
    units that are nothing but residue (in cases only), ``body`` the main units' texts without separator, lower-cased, only
    letters and digits. Duplicate rows count once; an article without text has no units, one without
    its page is judged by its words alone.
    """
    schema = "source_id long, case boolean, main array<int>, other array<int>, residue array<int>, body string"
    ints = pa.list_(pa.int32())
    kind = pa.schema([("source_id", pa.int64()), ("case", pa.bool_()), ("main", ints), ("other", ints), ("residue", ints), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        drop = re.compile(r"[\W_]+")
        for batch in batches:
            ids, cases, mains, others, residues, bodies = [], [], [], [], [], []
            for source, index, text, keys, labels in zip(*(batch.column(i).to_pylist() for i in range(5))):
                units, final, case, classes = judge(text, bool(index), keys, labels, models)
                ids.append(source)
                cases.append(case)
                inside = [i for i, x in enumerate(final) if x in (MAIN, VERBATIM, TABLE)]
                mains.append(inside)
                others.append([i for i, x in enumerate(final) if x not in (MAIN, VERBATIM, TABLE)])
                residues.append([i for i, c in enumerate(classes) if c and models.judge.pure(units[i], models.judge.shift(units, final, False))] if case else [])
                bodies.append(drop.sub("", "".join(units[i] for i in inside).lower()) if with_body and not case else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cases, pa.bool_()), pa.array(mains, ints), pa.array(others, ints), pa.array(residues, ints), pa.array(bodies, pa.string())],
                schema=kind,
            )

    own = articles.where("source_id is not null").select(F.col("source_id").cast("long").alias("source_id"), (F.col("kind") == "index").alias("index"), "text").dropDuplicates(["source_id"])
    blocks = page_labels(pages, models.weights).withColumnRenamed("page_id", "source_id")
    joined = own.join(blocks, "source_id", "left").select("source_id", "index", "text", "keys", "labels")
    return joined.mapInArrow(run, schema)


__all__ = ["Models", "fit", "judge", "judged"]
