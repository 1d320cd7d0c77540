"""Nearest vectors by cosine, in blocks of a matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block, and bytes of blocks that are broadcast at most.
BLOCK, MAX_BYTES = 2048, 256 << 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows scaled to length one; null, empty, zero and odd-sized vectors are rows of zeros."""
    out = np.zeros((len(column), width), np.float64)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the ``k`` nearest of all ``vectors`` (vec_id, embedding) to each of ``queries`` (query_id, embedding).

    A vector isn't its own neighbour (query_id = vec_id); ties by vec_id; a null, zero or odd-sized vector has cosine
    0. Queries go in blocks of BLOCK rows: every block meets every batch of vectors in one matrix product, and
    each task keeps the ``k`` best of each query, so what is shuffled follows queries times tasks, not pairs. Blocks
    are broadcast only up to MAX_BYTES in all (checked); more are joined one after the other.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("query_id is not null")
    n, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    schema = "query_id long, vec_id long, cosine double"
    width = max(0, width or 0)
    if not n or not width:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    step = max(1, MAX_BYTES // (8 * width))
    parts = -(-n // step)
    out = None
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else asked
        table = some.toArrow()
        ids, matrix = table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks(), width)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            best_v, best_c = np.full((len(ids), 0), 0, np.int64), np.full((len(ids), 0), 0.0)
            for batch in batches:
                vec = batch.column(0).to_numpy()
                unit = _matrix(batch.column(1), width).T
                new_v, new_c = [], []
                for at in range(0, len(ids), BLOCK):
                    rows = slice(at, at + BLOCK)
                    c = matrix[rows] @ unit
                    c[ids[rows, None] == vec] = -np.inf
                    v = np.concatenate((best_v[rows], np.broadcast_to(vec, c.shape)), 1)
                    c = np.concatenate((best_c[rows], c), 1)
                    by = np.lexsort((v, -c), axis=1)[:, :k]
                    new_v.append(np.take_along_axis(v, by, 1))
                    new_c.append(np.take_along_axis(c, by, 1))
                best_v, best_c = np.concatenate(new_v), np.concatenate(new_c)
            real = np.isfinite(best_c)
            q = np.broadcast_to(ids[:, None], best_c.shape)[real]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_v[real]), pa.array(best_c[real])], names=["query_id", "vec_id", "cosine"])

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
