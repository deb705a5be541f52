"""Exact nearest neighbours: a stated query set against all rows, in blocks.

Queries travel in lots of nearest.PASS vectors, so what is sent to the executors is bounded; each task reads its rows
once, compares them with a lot in blocks, keeps the k best of every query, and only those meet in the final top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.rows import top
from tessera.operators.nearest import BLOCK, Best, lots, passes


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; other sizes and nulls become zero, hence similarity 0."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.array([v if v is not None and len(v) == dim else [0.0] * dim for v in column.to_pylist()], np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def knn(base: DataFrame, queries: DataFrame, k: int, base_id: str = "id", query_id: str = "query_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, id, distance, rank (0-based): the k rows of base nearest to each query by cosine distance rounded to digits, ties by id. Filter base first: that is the prefilter."""
    spark = base.sparkSession
    rows = base.select(F.col(base_id).cast("long").alias("id"), F.col(vector).alias("embedding"))
    out = None
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("embedding")).where(F.col("embedding").isNotNull())
    for got in passes(asked, "query_id"):
        for dim in sorted({len(r.embedding) for r in got}):
            own = [r for r in got if len(r.embedding) == dim]
            ids, unit = np.array([r.query_id for r in own], np.int64), _unit(np.array([list(r.embedding) for r in own], np.float64).reshape(len(own), dim))
            shared = spark.sparkContext.broadcast((ids, unit))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
                ids, unit = shared.value
                best = Best(len(ids), k)
                for b in lots(batches):
                    rows, of = _unit(_matrix(b.column(1), dim)).T, b.column(0).to_numpy()
                    for at in range(0, len(ids), BLOCK):
                        best.add(at, np.round(1 - unit[at : at + BLOCK] @ rows, digits), of)
                q, i, d = best.rows(ids)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d + 0.0)], ["query_id", "id", "distance"])

            found = rows.mapInArrow(run, "query_id long, id long, distance double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, distance double")
    return top(out, ["query_id"], [F.col("distance"), F.col("id")], k, "rank")
