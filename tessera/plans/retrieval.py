"""Retrieval queries: nearest neighbours, BM25, fusion, overlays and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.rows import top
from tessera.functions.vector import hashed_bags
from tessera.operators import fusion, metrics
from tessera.operators.bm25 import bm25, bm25_sql
from tessera.operators.knn import knn
from tessera.plans.registry import query, table

#: Searches over embeddings ask for every row whose id is divisible by this.
EVERY = 20


def _knn_sql(base: str = "embeddings", extra: str = "", k: int = 10, queries: str = f"SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % {EVERY} = 0") -> str:
    return f"""
kq AS ({queries}),
kd AS (SELECT query_id, vec_id AS id, round(1 - list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS distance FROM kq JOIN {base} ON true {extra}),
knn AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM kd QUALIFY rank < {k})"""


@query(f"WITH {_knn_sql()} SELECT * FROM knn")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return knn(e, e.where(F.col("vec_id") % EVERY == 0), 10, "vec_id", "vec_id")


@query(f"WITH {_knn_sql()} SELECT * FROM knn WHERE distance IS NULL OR distance <= 0.7")
def vector_knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold comes after the top-k; a null distance passes."""
    return vector_knn(spark, sf_dir).where(F.col("distance").isNull() | (F.col("distance") <= 0.7))


@query(f"WITH {_knn_sql(extra='WHERE label = 3')} SELECT * FROM knn")
def vector_knn_label_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes before the top-k."""
    e = table(spark, sf_dir, "embeddings")
    return knn(e.where("label = 3"), e.where(F.col("vec_id") % EVERY == 0), 10, "vec_id", "vec_id")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents), qs AS (SELECT item_id AS query_id, text FROM benchmark)"
_BM25 = f"{_DOCS}, {bm25_sql('docs', 'qs')}"


@query(f"WITH {_BM25} SELECT * FROM bm")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), _bench(spark, sf_dir))


def _bags(df: DataFrame, id_col: str) -> DataFrame:
    return hashed_bags(df, id_col)


def _bag_sql(name: str, source: str, key: str) -> str:
    return rf"""
{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM {source}),
{name} AS (SELECT {key}, list_transform(range(64), lambda b: list_sum(list_transform(h, lambda x: CASE WHEN x = b THEN 1.0 ELSE 0.0 END))) AS v
  FROM (SELECT {key}, list(('0x' || substr(sha256(t), 1, 4))::int % 64) AS h FROM {name}_t GROUP BY {key}))"""


_BAG_KNN = f"""{_bag_sql('db', 'docs', 'id')}, {_bag_sql('qb', 'qs', 'query_id')},
vk AS (SELECT query_id, id, round(1 - list_cosine_similarity(qb.v, db.v), 6) AS distance FROM qb, db),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM vk QUALIFY rank < 10)"""


def _fused(wv: str, wk: str) -> str:
    return f"""
parts AS (SELECT query_id, id, {wv} / (60 + rank) AS p FROM vec JOIN qs USING (query_id) UNION ALL SELECT query_id, id, {wk} / (60 + rank) FROM bm JOIN qs USING (query_id)),
fs AS (SELECT query_id, id, round(sum(p), 9) AS fused FROM parts GROUP BY ALL),
fused AS (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) - 1 AS rank FROM fs QUALIFY rank < 10)"""


def _fuse_sql(wv: str, wk: str) -> str:
    return f"{_fused(wv, wk)} SELECT * FROM fused"


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, asked = table(spark, sf_dir, "documents"), _bench(spark, sf_dir)
    return knn(_bags(docs, "doc_id"), _bags(asked, "query_id").withColumnRenamed("id", "query_id"), 10), bm25(docs, asked)


@query(f"WITH {_BM25}, {_BAG_KNN}, {_fuse_sql('0.6', '0.4')}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.hybrid(*_lists(spark, sf_dir))


@query(f"WITH {_BM25}, {_BAG_KNN}, {_fused('0.3', '0.7')} SELECT fused.*, distance FROM fused JOIN vk USING (query_id, id) WHERE distance <= 0.4")
def hybrid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-only hits get their real distance, so the threshold holds for them as well."""
    docs, asked = table(spark, sf_dir, "documents"), _bench(spark, sf_dir)
    base, own = _bags(docs, "doc_id"), _bags(asked, "query_id").withColumnRenamed("id", "query_id")
    fused = fusion.hybrid(knn(base, own, 10), bm25(docs, asked), weights=(0.3, 0.7))
    return fusion.with_distances(fused, own, base, 0.4)


_TILT = r"(length(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 3 AND (regexp_matches(text, '[_:(.<>]') OR (regexp_matches(text, '\p{Lu}') AND regexp_matches(text, '\p{Ll}'))))"


@query(f"WITH {_BM25}, {_BAG_KNN}, {_fuse_sql(f'CASE WHEN {_TILT} THEN 0.3 ELSE 0.6 END', f'CASE WHEN {_TILT} THEN 0.7 ELSE 0.4 END')}")
def hybrid_auto_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, key = _lists(spark, sf_dir)
    asked = _bench(spark, sf_dir)
    wv, wk = fusion.auto_weights(F.col("text"))
    return fusion.hybrid(vec.join(asked, "query_id"), key.join(asked, "query_id"), weights=(wv, wk))


_TURNS = "turns AS (SELECT conv_id * 1000 + turn AS query_id, text, conv_id FROM conversations WHERE role = 'user' AND conv_id % 20 = 0)"


@query(f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {_TURNS}, {bm25_sql('docs', 'turns')},
f AS (SELECT query_id // 1000 AS conv_id, id, round(sum(1.0 / (60 + rank)), 9) AS fused, NULL::DOUBLE AS distance FROM bm GROUP BY ALL)
SELECT conv_id, id, fused, row_number() OVER (PARTITION BY conv_id ORDER BY fused DESC, id) - 1 AS rank FROM f QUALIFY rank < 10""")
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns of one conversation are the queries of one search; keyword-only rows have no distance."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 20 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    lists = bm25(table(spark, sf_dir, "documents"), turns).select(F.floor(F.col("query_id") / 1000).cast("long").alias("conv_id"), "id", "rank", F.lit(None).cast("double").alias("distance"))
    fused = fusion.fuse_queries(lists, ["conv_id", "id"], 0.9)
    return top(fused, ["conv_id"], fusion.fused_order("id"), 10, "rank").select("conv_id", "id", "fused", "rank")


_ALL = [("documents", "doc_id", "text", 0), ("pages", "page_id", "html", 1), ("conversations", "conv_id * 1000 + turn", "text", 2)]


def _all_sql() -> str:
    parts = []
    for name, key, text, n in _ALL:
        cte = bm25_sql(f"m{n}", "qs")
        for w in ("d_words", "d_size", "d_post", "q_terms", "d_df", "bm_all"):
            cte = cte.replace(w, f"{w}{n}")
        cte = cte.replace("bm AS (", f"bm{n} AS (")
        parts.append(f"m{n} AS (SELECT {key} AS id, {text} AS text FROM {name}), {cte}")
    union = " UNION ALL ".join(f"SELECT query_id, {n} AS modality, id, round(1.0 / (60 + rank), 9) AS fused FROM bm{n}" for *_, n in _ALL)
    return f"""WITH qs AS (SELECT item_id AS query_id, text FROM benchmark), {", ".join(parts)}, u AS ({union})
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, modality, id) - 1 AS rank FROM u QUALIFY rank < 10"""


@query(_all_sql())
def all_mode_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three modalities, each ranked by itself; one cap over all of them."""
    out = None
    for name, key, text, n in _ALL:
        rows = table(spark, sf_dir, name).select(F.expr(key).alias("id"), F.col(text).alias("text"))
        part = bm25(rows, _bench(spark, sf_dir), id_col="id").select("query_id", F.lit(n).alias("modality"), "id", F.round(1 / (config.RRF_K + F.col("rank")), 9).alias("fused"))
        out = part if out is None else out.unionByName(part)
    return top(out, ["query_id"], [F.col("fused").desc(), F.col("modality"), F.col("id")], 10, "rank")


@query(f"""WITH main AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 1), branch AS (SELECT * FROM embeddings WHERE vec_id % 5 = 1),
gone AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 2),
{_knn_sql('main', k=20).replace('knn AS', 'km AS')}, {_knn_sql('branch').replace('kq AS', 'kq2 AS').replace('kd AS', 'kd2 AS').replace('FROM kq ', 'FROM kq2 ').replace('FROM kd ', 'FROM kd2 ').replace('knn AS', 'kb AS')},
u AS (SELECT query_id, id, distance, 0 AS origin FROM kb UNION ALL SELECT query_id, id, distance, 1 FROM km WHERE id NOT IN (SELECT vec_id FROM gone))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS FIRST, origin, id) - 1 AS rank FROM u QUALIFY rank < 10""")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch replaces rows of the main table; the main budget is doubled so that enough is left."""
    e = table(spark, sf_dir, "embeddings")
    asked, tail = e.where(F.col("vec_id") % EVERY == 0), F.col("vec_id") % 5
    main = knn(e.where(tail != 1), asked, 20, "vec_id", "vec_id").drop("rank")
    branch = knn(e.where(tail == 1), asked, 10, "vec_id", "vec_id").drop("rank")
    return fusion.overlay(main, branch, e.where(tail == 2).select(F.col("vec_id").alias("id")), "id", ["query_id"], "id", 10)


_SCORE = "(id * 7919 % 1000) / 1000.0"


@query(f"""WITH {_BM25}, c AS (SELECT query_id, id, rank, round(1 - CASE WHEN id % 11 <> 0 THEN {_SCORE} END, 6) AS d FROM bm WHERE rank < 8)
SELECT query_id, id, coalesce(d, 1.0) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(d, 1.0), rank) - 1 AS place FROM c QUALIFY place < 5""")
def rerank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-stage scores come from a column; some are missing."""
    return fusion.cross_encoder(fts_bm25(spark, sf_dir), F.when(F.col("id") % 11 != 0, F.expr(_SCORE).cast("double")), "query_id", 8, 5)


@query(f"""WITH {_BM25}, j AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, id) AS judged FROM bm JOIN labels ON id = doc_id),
f AS (SELECT query_id, id, rank, round(1.0 / (60 + rank) + coalesce(2.0 / (60 + judged), 0), 9) AS fused, count(*) OVER (PARTITION BY query_id) AS n FROM bm LEFT JOIN j USING (query_id, id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, rank) - 1 AS place FROM f)
SELECT query_id, id, fused, place, round((place + 1) / (n + 1), 6) AS distance FROM o WHERE place < 5""")
def reasoning_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge ranks some of the hits, counting from 1."""
    hits = fts_bm25(spark, sf_dir)
    judged = hits.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    judged = top(judged, ["query_id"], [F.col("quality").desc(), F.col("id")], 1000, "rank").select("query_id", "id", (F.col("rank") + 1).alias("rank"))
    return fusion.reasoning(hits, judged, "query_id", 5)


_TRUTH = "truth AS (SELECT item_id AS query_id, doc_id AS id, 1 + coalesce(quality, 0) AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id))"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage whole; the match operator finds candidates by a shared rare word before it compares."""
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), _bench(spark, sf_dir).select("query_id", F.col("text").alias("passage"))
    found = metrics.containing(docs, asked)
    return found.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("query_id", F.col("doc_id").alias("id"), (1 + F.coalesce("quality", F.lit(0))).cast("double").alias("grade"))


@query(f"""WITH {_BM25}, {_TRUTH},
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM truth),
i AS (SELECT query_id, count(*) AS n_truth, sum(grade / log2(n + 1)) FILTER (n <= 10) AS ideal FROM t GROUP BY query_id),
r AS (SELECT query_id, rank + 1 AS place, grade FROM bm JOIN truth USING (query_id, id)),
m AS (SELECT query_id, max((place <= 5)::int) AS hit_5, max((place <= 10)::int) AS hit_10, 1.0 / min(place) AS rr, sum(grade / log2(place + 1)) FILTER (place <= 10) AS dcg,
  count(*) FILTER (place <= 5) AS r5, count(*) FILTER (place <= 10) AS r10 FROM r GROUP BY query_id)
SELECT query_id, coalesce(hit_5, 0)::double AS hit_at_5, coalesce(hit_10, 0)::double AS hit_at_10, round(coalesce(rr, 0), 6)::double AS mrr, round(coalesce(dcg, 0) / ideal, 6) AS ndcg_at_10,
  round(coalesce(r5, 0) / n_truth, 6) AS recall_at_5, round(coalesce(r10, 0) / n_truth, 6) AS recall_at_10 FROM i LEFT JOIN m USING (query_id)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_query(fts_bm25(spark, sf_dir), _truth(spark, sf_dir))


@query(f"""WITH {_BM25}, {_TRUTH},
r AS (SELECT bm.query_id, source AS file, min(rank) AS rank FROM bm JOIN documents ON id = doc_id GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r),
t AS (SELECT DISTINCT query_id, source AS file FROM truth JOIN documents ON id = doc_id),
h AS (SELECT t.query_id, count(*) AS n, min(place) AS first, count(*) FILTER (place <= 5) AS in5, count(*) FILTER (place <= 10) AS in10, count(place) AS found FROM t LEFT JOIN o USING (query_id, file) GROUP BY t.query_id)
SELECT query_id, coalesce(first <= 1, false) AS hit_at_1, coalesce(first <= 5, false) AS hit_at_5, coalesce(first <= 10, false) AS hit_at_10, in5 = n AS acc_at_5, in10 = n AS acc_at_10,
  round(found / n, 6) AS recall, round(coalesce(1.0 / first, 0), 6)::double AS mrr FROM h""")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results collapsed to the first of each file (here: source)."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    hits = fts_bm25(spark, sf_dir).join(source, "id").select("query_id", "file", "rank")
    return metrics.per_file(hits, _truth(spark, sf_dir).join(source, "id").select("query_id", "file"))
