"""Roll-ups, upserts, budgets and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fusion, graph, incremental, metrics
from tessera.plans import index as ix
from tessera.plans.registry import query, table
from tessera.plans.retrieval import _BAG_KNN, _BM25, _TRUTH, _lists, _truth
from tessera.plans.texts import conventional_commits


@query("""WITH b AS (SELECT source AS path, doc_id::int AS start_line, n_chars::int AS end_line, text AS content, [lang, lang || (doc_id % 5)] AS symbols FROM documents)
SELECT path, array_to_string(list_sort(list_distinct(flatten(list(symbols)))), ',') AS symbols, max(end_line) AS size_lines, sha256(string_agg(content, chr(10) ORDER BY start_line) || path) AS hash FROM b GROUP BY path""")
def file_node_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a file as one graph node."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").cast("int").alias("start_line"), F.col("n_chars").cast("int").alias("end_line"), F.col("text").alias("content"), F.array("lang", F.concat("lang", F.col("doc_id") % 5)).alias("symbols"))
    return ix.file_nodes(rows).withColumn("symbols", F.array_join("symbols", ","))


@query("""WITH c AS (SELECT CASE turn % 4 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'breaking' ELSE 'feat' END AS category, role, turn FROM conversations)
SELECT category, count(*) AS n FROM c GROUP BY category""")
def commit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conventional_commits(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT lower(regexp_extract(regexp_extract(url, '://[^/]*([^?#]*)', 1), '[.]([^./]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def file_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"://[^/]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(T.extension(path).alias("ext")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id AS query_id, event_type AS path, (event_id * 37 % 5000)::int AS start, (event_id * 37 % 5000 + event_id % 60)::int AS "end", (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::int AS rank FROM events WHERE event_id % 2 = 0),
t AS (SELECT user_id AS query_id, event_type AS path, (event_id * 53 % 5000)::int AS t_start, (event_id * 53 % 5000 + event_id % 90)::int AS t_end, (1 + event_id % 3)::double AS grade FROM events WHERE event_id % 2 = 1)
SELECT r.query_id, r.rank, r.path, r.start, r."end", coalesce(max(grade), 0) AS grade FROM r LEFT JOIN t ON r.query_id = t.query_id AND r.path = t.path AND t_start <= "end" AND start <= t_end GROUP BY ALL""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best grade among overlapping truths of the same path."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("path"), "event_id")
    i = F.col("event_id")
    res = e.where(i % 2 == 0).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("event_id")) - 1)
    res = res.select("query_id", "rank", "path", (i * 37 % 5000).cast("int").alias("start"), (i * 37 % 5000 + i % 60).cast("int").alias("end"))
    tru = e.where(i % 2 == 1).select("query_id", "path", (i * 53 % 5000).cast("int").alias("t_start"), (i * 53 % 5000 + i % 90).cast("int").alias("t_end"), (1 + i % 3).cast("double").alias("grade"))
    return metrics.range_grades(res, tru)


VARIANTS = {"vector": (1.0, 0.0), "balanced": (0.7, 0.3), "keyword": (0.3, 0.7)}


def _matrix_sql() -> str:
    parts = []
    for name, (wv, wk) in VARIANTS.items():
        lists = " UNION ALL ".join(f"SELECT query_id, id, {w} / (60 + rank) AS p FROM {t}" for t, w in (("vec", wv), ("bm", wk)))
        parts.append(f"""SELECT '{name}' AS variant, round(avg(coalesce(rr, 0)), 6)::double AS mrr, round(avg(coalesce(hit, 0)), 6)::double AS hit_at_5 FROM (SELECT DISTINCT query_id FROM truth) q LEFT JOIN (
          SELECT query_id, round(1.0 / min(place), 6) AS rr, max((place <= 5)::int) AS hit FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, id) AS place FROM (SELECT query_id, id, round(sum(p), 9) AS f FROM ({lists}) GROUP BY ALL) QUALIFY place <= 10) JOIN truth USING (query_id, id) GROUP BY query_id) USING (query_id)""")
    return f"WITH {_BM25}, {_BAG_KNN}, {_TRUTH} " + " UNION ALL ".join(parts)


@query(_matrix_sql())
def variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists fused by several weights, scored against one truth."""
    vec, key = _lists(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(wv).alias("wv"), F.lit(wk).alias("wk")) for n, (wv, wk) in VARIANTS.items()])).alias("v")
    spread = lambda df, *more: df.select(each, *df.columns).withColumn("query_id", F.struct("v.variant", "query_id")).select("query_id", "id", *more)
    hits = fusion.hybrid(spread(vec, "rank", F.col("v.wv").alias("w")), spread(key, "rank", F.col("v.wk").alias("w")), weights=(F.col("w"), F.col("w")))
    per = metrics.per_query(hits, spread(_truth(spark, sf_dir), "grade"))
    return per.groupBy(F.col("query_id.variant").alias("variant")).agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("hit_at_5"), 6).alias("hit_at_5"))


@query("""WITH s AS (SELECT doc_id, source AS path, CASE WHEN doc_id % 2 = 0 THEN lang END AS owner, 'f' || (doc_id % 6) AS name, (doc_id % 50)::int AS start_line FROM documents)
SELECT doc_id, path || '::' || coalesce(owner || '::', '') || name || CASE WHEN count(*) OVER (PARTITION BY path, owner, name) > 1 THEN '@' || (start_line + 1) ELSE '' END AS id FROM s""")
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("owner"), F.concat(F.lit("f"), F.col("doc_id") % 6).alias("name"), (F.col("doc_id") % 50).cast("int").alias("start_line"))
    return graph.symbol_ids(rows).select("doc_id", "id")


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages UNION SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_extract(url, '://[^/]*/([^/?#]*)', 1) FROM pages)
SELECT regexp_extract(c.path, '^(.*)/[^/]+$', 1) AS parent, c.path AS child FROM p c JOIN p ON p.path = regexp_extract(c.path, '^(.*)/[^/]+$', 1) WHERE p.path <> ''""")
def parent_child_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = table(spark, sf_dir, "pages").select("url")
    whole = url.select(F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "").alias("path"))
    head = url.select(F.concat(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", r"://[^/]*/([^/?#]*)", 1)).alias("path"))
    return graph.parent_child(whole.unionByName(head).distinct())


@query("""WITH o AS (SELECT user_id AS path, event_id, floor(epoch(ts))::bigint AS "at", 0 AS new FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, event_id, floor(epoch(ts))::bigint, 1 FROM events WHERE event_id % 3 > 0)
SELECT path, max("at") AS "at" FROM o GROUP BY path""")
def upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 3).alias("m"))
    return incremental.upsert(e.where("m = 0").drop("m"), e.where("m > 0").drop("m"), ["path"], "at")


@query("SELECT source, doc_id FROM documents QUALIFY sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) <= 40000")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest blocks of a file that fit a budget."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return incremental.token_budget(rows, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], "n_chars", 40000).drop("n_chars")


@query("SELECT l_partkey AS source, l_returnflag AS relation_type, array_to_string(list_sort(list_distinct(list(l_suppkey)))::VARCHAR[], ',') AS targets FROM lineitem GROUP BY ALL")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("relation_type"), F.col("l_suppkey").alias("target"))
    return graph.adjacency(edges).withColumn("targets", F.array_join("targets", ","))


@query("""WITH n AS (SELECT 'S' || s_name AS name, s_nationkey % 3 AS k FROM supplier), w AS (SELECT lower(name) AS concept, 1.0 AS weight FROM n UNION ALL SELECT 'kind' || k, 0.8 FROM n)
SELECT concept, max(weight)::double AS weight FROM w GROUP BY concept""")
def key_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_name").alias("name"), F.concat(F.lit("Kind"), F.col("s_nationkey") % 3).alias("kind"), F.lit("").alias("description"))
    return ix.key_concepts(nodes)
