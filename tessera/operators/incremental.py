"""Incremental maintenance: diffs by content hash, skips, upserts, cascades, statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rows import top


def hash_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., action: insert for rows of new only, delete for rows of old only, keep for the rest."""
    a, b = old.select(*keys).distinct().withColumn("o", F.lit(True)), new.select(*keys).distinct().withColumn("n", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("keep").alias("action"))


def changed(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files(path, mtime) that are newer than their stored mtime, or not stored."""
    return files.join(metadata.select("path", F.col("mtime").alias("stored")), "path", "left").where(F.col("stored").isNull() | (F.col("mtime") > F.col("stored"))).drop("stored")


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Last writer wins: of each key the row with the greatest `by`, new rows before stored ones on ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return top(both, keys, [F.col(by).desc(), F.col("_new").desc()], 1).drop("_new")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top(rows, keys, order, 1)


def cascade_delete(tables: dict[str, DataFrame], paths: DataFrame, column: str = "path") -> dict[str, DataFrame]:
    """Every table without the rows of paths(path). Edges go with either end."""
    out = {}
    for name, df in tables.items():
        for c in [column] if column in df.columns else [c for c in ("source", "target") if c in df.columns]:
            df = df.join(paths.select(F.col("path").alias(c)), c, "left_anti").select(*df.columns)
        out[name] = df
    return out


def missing(indexed: DataFrame, on_disk: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Indexed paths that are gone or ignored now."""
    gone = indexed.select("path").distinct().join(on_disk, "path", "left_anti")
    return gone if ignored is None else gone.unionByName(indexed.select("path").distinct().join(ignored.select("path"), "path", "left_semi")).distinct()


def distinct_paths(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("path")
    for t in tables[1:]:
        out = out.unionByName(t.select("path"))
    return out.distinct()


def index_params(n: int, always_root: bool = False) -> int | None:
    """Partitions of a vector index, 2 to 1024: none below 1000 rows, about the root, one for 1,048,576 rows from that many on unless always_root."""
    if n < 1000:
        return None
    return min(1024, max(2, n // 1_048_576 if n >= 1_048_576 and not always_root else math.isqrt(n)))


def should_recreate(partitions_now: int, partitions_wanted: int) -> bool:
    """More than half off."""
    return abs(partitions_now - partitions_wanted) > partitions_now * 0.5


def needs_reindex(rows_then: int, rows_now: int) -> bool:
    return rows_now > rows_then * 1.5


def candidate_budget(max_results: int, n_queries: int, reranker_top_k: int | None = None, overlay: bool = False) -> int:
    base = reranker_top_k if reranker_top_k is not None else max(2 * max_results // max(n_queries, 1), 1)
    return base * 2 if overlay else base


def rerank_headroom(cap: int) -> int:
    """Hits kept before graph expansion when a reranker follows."""
    return max(cap - max(cap // 5, 1), 1)


def token_budget(rows: DataFrame, by: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their sizes fit the budget."""
    total = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def overridden(changed_paths: DataFrame, working: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to index on the branch, paths that hide the main index)."""
    all_changed = changed_paths.select("path").unionByName(working.select("path")).distinct()
    return all_changed.join(deleted, "path", "left_anti"), all_changed.unionByName(deleted.select("path")).distinct()


def coherent(base_commit: str, main_commit: str | None) -> bool:
    """A branch index fits the main index of its base commit; one without a base commit is of an old kind and fits any."""
    return base_commit == "" or base_commit == main_commit


def with_symbol(rows: DataFrame, symbol: str, like: bool = False) -> DataFrame:
    """Rows that have the symbol. like: by LIKE on the symbols' JSON text, as an index of texts would: % and _ are wildcards there."""
    return rows.where(F.to_json("symbols").like(f"%{symbol}%") if like else F.array_contains("symbols", symbol))


def by_key(rows: DataFrame, column: str, value: object, limit: int, *order: str) -> DataFrame:
    """Up to `limit` rows with this value, in order."""
    return rows.where(F.col(column) == F.lit(value)).orderBy(*order).limit(limit)


def batches(rows: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """by, order, batch: items of each group in order; a batch is full once it has `most` items or `budget` in size.

    A batch's start depends on the one before it, so a group passes one task as a stream of (order, size) pairs.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, order)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, items, total = None, 0, 0, 0
        for b in parts:
            out = []
            for k, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key or not items:
                    key, n, items, total = k, 0, 0, 0
                elif items >= most or total >= budget:
                    n, items, total = n + 1, 0, 0
                items, total = items + 1, total + s
                out.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], [by, order, "batch"])

    return rows.select(by, order, size).repartition(by).sortWithinPartitions(by, order).mapInArrow(run, f"{by} {kinds[by]}, {order} {kinds[order]}, batch int")


def content_sample(rows: DataFrame, by: list[str], order: list, text: str, tokens: str, budget: int, ends: int = 150) -> DataFrame:
    """Rows of each group, in order, while their tokens (and 50 a row for its frame) stay below the budget, with a sample of the text: whole up to twice `ends` bytes, else both ends."""
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_total", F.sum(F.col(tokens) + 50).over(whole) - 50).where(F.col("_total") < budget).drop("_total")
    short = F.octet_length(text) <= 2 * ends
    return out.withColumn("sample", F.when(short, F.col(text)).otherwise(F.concat(F.substring(text, 1, ends), F.lit("\n...\n"), F.substring(text, -ends, ends))))
