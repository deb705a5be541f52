"""Search end to end: several queries, vector and keyword lists per modality, fusion, overlay, expansion, second stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.rows import top
from tessera.operators import fusion, graph
from tessera.operators.blocks import embedded
from tessera.operators.bm25 import bm25
from tessera.operators.incremental import candidate_budget, rerank_headroom
from tessera.operators.knn import knn

MODES = ("code", "document", "text", "commits", "all")


@dataclass
class Request:
    """1 to 10 queries of 3 to 500 bytes; threshold: least similarity; weights None: chosen by each query's form."""

    queries: list[str]
    mode: str = "all"
    max_results: int = config.TOP_K
    threshold: float | None = None
    language: str | None = None
    weights: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.queries) <= config.MAX_QUERIES:
            raise ValueError(f"1 to {config.MAX_QUERIES} queries, not {len(self.queries)}")
        for q in self.queries:
            if not 3 <= len(q.strip().encode()) <= 500:
                raise ValueError("a query has 3 to 500 bytes")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("threshold lies in 0..1")
        if not 1 <= self.max_results <= 20:
            raise ValueError("max_results lies in 1..20")
        if self.weights is not None and (not all(0 <= w <= 1 for w in self.weights) or not any(self.weights)):
            raise ValueError("weights lie in 0..1 and one is above 0")


def retrieve(blocks: DataFrame, request: Request, budget: int) -> DataFrame:
    """query_id, hash, rank, distance: hybrid lists of every query over embedded blocks (filtered before the top-k)."""
    spark = blocks.sparkSession
    asked = embedded(spark.createDataFrame(list(enumerate(request.queries)), "query_id int, text string"), "text").withColumn("query_id", F.col("query_id").cast("long"))
    rows = blocks if request.language is None else blocks.where((F.col("modality") != "code") | (F.col("language") == request.language))
    rows = rows.dropDuplicates(["hash"]).withColumn("block", F.xxhash64("hash"))
    vec = knn(rows, asked, budget, "block")
    key = bm25(rows, asked.select("query_id", "text"), budget, "block", "content")
    wv, wk = fusion.auto_weights(F.col("text")) if request.weights is None else map(F.lit, request.weights)
    text = asked.select("query_id", "text")
    fused = fusion.hybrid(vec.join(text, "query_id"), key.join(text, "query_id"), budget, (wv, wk))
    stored = rows.select(F.col("block").alias("id"), "embedding")
    out = fusion.with_distances(fused, asked, stored, None if request.threshold is None else 1 - request.threshold)
    return out.join(rows.select(F.col("block").alias("id"), "hash"), "id").select("query_id", "hash", "rank", "distance")


def search(
    blocks: DataFrame, request: Request, branch: tuple[DataFrame, DataFrame] | None = None, edges: DataFrame | None = None, scorer: Callable[[Column, Column], Column] | None = None, candidates: int = 50,
) -> DataFrame:
    """Blocks with place, fused score and distance.

    branch: (blocks of the branch, overridden paths). edges: file graph for expansion. scorer: second stage, a
    score of (query text, content); with it the threshold is left to the caller and some room is kept for expansion.
    """
    rows = blocks if request.mode == "all" else blocks.where(F.col("modality") == request.mode)
    rows = rows.where("modality <> 'commit'") if request.mode == "all" else rows
    plain = request if scorer is None else Request(request.queries, request.mode, request.max_results, None, request.language, request.weights)
    budget = candidate_budget(request.max_results, len(request.queries), candidates if scorer else None)
    lists = retrieve(rows, plain, candidate_budget(request.max_results, len(request.queries), candidates if scorer else None, branch is not None))
    lists = lists.join(rows.dropDuplicates(["hash"]).select("hash", "path", "modality"), "hash")
    if branch is not None:
        over = retrieve(branch[0], plain, budget).join(branch[0].dropDuplicates(["hash"]).select("hash", "path", "modality"), "hash")
        lists = fusion.overlay(lists.drop("rank"), over.drop("rank"), branch[1], "path", ["query_id", "modality"], "hash", budget).drop("origin")
        rows = rows.join(branch[1], "path", "left_anti").unionByName(branch[0].select(*rows.columns))
    fused = fusion.fuse_queries(lists, ["modality", "hash"], None if plain.threshold is None else 1 - plain.threshold)
    order = F.create_map(*[F.lit(x) for kv in {"code": 0, "text": 1, "document": 2, "commit": 3}.items() for x in kv])
    fused = fused.withColumn("_all", F.lit(0)).withColumn("m", F.element_at(order, F.col("modality")))
    keep = rerank_headroom(candidates) if scorer and edges is not None else candidates if scorer else request.max_results
    out = top(fused, ["_all"], [F.col("fused").desc(), F.col("m"), F.col("distance").asc_nulls_first(), F.col("hash")], keep, "place").select("hash", "fused", "distance", "place")
    full = rows.dropDuplicates(["hash"])
    if edges is not None:
        hits = out.join(full.select("hash", "path"), "hash").select(F.lit(0).alias("query_id"), "hash", "path", F.col("place").alias("rank"))
        more = graph.expand(hits, full.where("modality = 'code'").select("path", "hash", "start_line"), edges)
        out = out.unionByName(more.select("hash", F.lit(None).cast("double").alias("fused"), F.lit(None).cast("double").alias("distance"), (F.col("added") + keep).alias("place")))
    out = out.join(full, "hash")
    if scorer is not None:
        score = scorer(F.lit(" ".join(request.queries)), F.col("content"))
        out = out.withColumn("distance", F.coalesce(F.round(1 - score, 6), F.lit(1.0))).withColumn("_all", F.lit(0))
        out = top(out.drop("rank"), ["_all"], [F.col("distance"), F.col("place")], request.max_results, "rank").withColumn("place", F.col("rank")).drop("rank", "_all")
    return out


def overlap_score(query: Column, content: Column) -> Column:
    """Offline second stage: the share of query words that the content holds."""
    from tessera.functions.rows import tokens

    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(content))) / F.greatest(F.size(q), F.lit(1))


def expand_symbols(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that declare symbols of the hits: names that start with a letter and have no underscore in front; one block a symbol, most shared symbols first."""
    named = hits.select(F.explode("symbols").alias("symbol")).where(F.col("symbol").rlike("^[A-Za-z]")).distinct()
    found = blocks.select("hash", "path", "start_line", F.explode("symbols").alias("symbol")).join(named, "symbol")
    one = top(found, ["symbol"], [F.col("path"), F.col("start_line"), F.col("hash")], 1)
    new = one.join(hits.select("hash"), "hash", "left_anti").groupBy("hash", "path", "start_line").agg(F.count("*").alias("shared"))
    return new.orderBy(F.col("shared").desc(), "path", "start_line")
