"""Graph, resolution and interval queries. The graph: region, nation, customer, supplier, and parts by line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rows import top
from tessera.operators import graph, resolve
from tessera.operators.knn import knn
from tessera.plans.registry import query, table
from tessera.plans.retrieval import EVERY, _knn_sql

_TREE = [("region", "r_regionkey", "nation", "n_nationkey", "n_regionkey"), ("nation", "n_nationkey", "customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "supplier", "s_suppkey", "s_nationkey")]
_EDGES_SQL = "edges AS (" + " UNION ALL ".join(f"SELECT '{p}:' || {fk} AS source, '{c}:' || {ck} AS target, '{'contains' if p == 'region' else 'imports' if c == 'customer' else 'calls'}' AS relation_type FROM {c}" for p, _, c, ck, fk in _TREE) + ")"
_NODES = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
_NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id, {n} AS name, '{t}' AS kind FROM {t}" for t, k, n in _NODES) + ")"


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for p, _, c, ck, fk in _TREE:
        kind = "contains" if p == "region" else "imports" if c == "customer" else "calls"
        part = table(spark, sf_dir, c).select(F.concat(F.lit(f"{p}:"), fk).alias("source"), F.concat(F.lit(f"{c}:"), ck).alias("target"), F.lit(kind).alias("relation_type"))
        out = part if out is None else out.unionByName(part)
    return out


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, k, n in _NODES:
        part = table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), k).alias("id"), F.col(n).alias("name"), F.lit(t).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_EDGES_SQL}, s AS (SELECT 'nation:' || n_nationkey AS id FROM nation)
SELECT id, target AS neighbour, relation_type, 'outgoing' AS direction FROM s JOIN edges ON source = id
UNION ALL SELECT id, source, relation_type, 'incoming' FROM s JOIN edges ON target = id""")
def neighbors_out_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return graph.neighbours(tree_edges(spark, sf_dir), seeds)


@query(f"WITH {_EDGES_SQL}, s AS (SELECT 'nation:' || n_nationkey AS id FROM nation) SELECT id, target AS neighbour, relation_type, 'outgoing' AS direction FROM s JOIN edges ON source = id WHERE relation_type = 'calls'")
def relations_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return graph.neighbours(tree_edges(spark, sf_dir), seeds, "outgoing", "calls")


@query(f"""WITH RECURSIVE {_EDGES_SQL}, w(start, id, depth) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region
UNION ALL SELECT start, target, depth + 1 FROM w JOIN edges ON source = w.id WHERE depth < 3) SELECT start, id, min(depth) AS depth FROM w GROUP BY start, id""")
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    return graph.reach(tree_edges(spark, sf_dir), start, 3)


@query(f"""WITH RECURSIVE {_EDGES_SQL}, w(source, id, length, path) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0, ['region:' || r_regionkey] FROM region
UNION ALL SELECT w.source, e.target, length + 1, list_append(path, e.target) FROM w JOIN edges e ON e.source = w.id WHERE length < 3 AND NOT list_contains(path, e.target))
SELECT source, id AS target, length, array_to_string(path, '>') AS path FROM w WHERE id LIKE 'supplier:%'""")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    end = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return graph.paths(tree_edges(spark, sf_dir), start, end, 3).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {_NODES_SQL}, own AS (SELECT 'nation:' || n_nationkey AS id, n_regionkey AS r FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_regionkey FROM region
UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id, coalesce(min(id) OVER (PARTITION BY r), id) AS component FROM own UNION ALL SELECT id, id FROM nodes WHERE kind = 'part'""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(tree_edges(spark, sf_dir), all_nodes(spark, sf_dir))


@query(f"""WITH {_NODES_SQL}, {_EDGES_SQL} SELECT 'node' AS section, kind AS name, count(*) AS n FROM nodes GROUP BY ROLLUP (kind)
UNION ALL SELECT 'edge', relation_type, count(*) FROM edges GROUP BY ROLLUP (relation_type)""")
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.overview(all_nodes(spark, sf_dir), tree_edges(spark, sf_dir))


_SEARCH = ["green", "almond", "the", "customer#000000012", "nation", "supplier", "asia", "uses", "on", "who"]
_STOP = "'a', 'an', 'and', 'are', 'by', 'calls', 'does', 'for', 'from', 'how', 'in', 'is', 'of', 'or', 'the', 'to', 'uses', 'what', 'where', 'who'"


@query(f"""WITH {_NODES_SQL}, low AS (SELECT id, lower(name) AS n, string_split(lower(name), ' ') AS al, lower(id || ' ' || kind) AS p FROM nodes),
t AS (SELECT * FROM (VALUES {", ".join(f"({i % 2}, '{w}')" for i, w in enumerate(_SEARCH))}) AS t(query_id, term) WHERE term NOT IN ({_STOP})),
h AS (SELECT query_id, id, CASE WHEN n = term THEN 100 WHEN starts_with(n, term) THEN 40 WHEN contains(n, term) THEN 20 WHEN list_contains(al, term) THEN 30
  WHEN len(list_filter(al, lambda a: contains(a, term))) > 0 THEN 10 WHEN contains(p, term) THEN 5 END AS tier FROM low, t)
SELECT query_id, id, sum(tier)::bigint AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(tier) DESC, length(id), id) - 1 AS rank FROM h WHERE tier IS NOT NULL GROUP BY query_id, id QUALIFY rank < 20""")
def node_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(i % 2, w) for i, w in enumerate(_SEARCH)], "query_id int, term string")
    nodes = all_nodes(spark, sf_dir).select("id", "name", F.split(F.lower("name"), " ").alias("aliases"), F.col("kind").alias("path"))
    return graph.search_nodes(nodes, terms, 20)


@query(f"""WITH {_knn_sql(k=50)}, n AS (SELECT vec_id AS id, 'label' || label AS name FROM embeddings),
f AS (SELECT query_id, id, distance, contains(name, 'label3') AS text_hit FROM knn JOIN n USING (id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_hit DESC, distance, id) - 1 AS place FROM f WHERE text_hit OR 1 - distance > 0.5 QUALIFY place < 20""")
def node_semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    nodes = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("label"), "label").alias("name"), F.lit("vector").alias("kind"), F.lit("").alias("description"), F.array().cast("array<string>").alias("symbols"))
    return graph.node_filter(knn(e, e.where(F.col("vec_id") % EVERY == 0), 50, "vec_id", "vec_id"), nodes, "label3", 0.5, 20)


#: Part to supplier edges by line items: the weight is the quantity share, the confidence falls with the discount.
_PS_SQL = "ps AS (SELECT l_partkey AS source, l_suppkey AS target, sum(l_quantity) AS weight, max(1 - l_discount) AS confidence FROM lineitem GROUP BY ALL)"


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.sum("l_quantity").alias("weight"), F.max(1 - F.col("l_discount")).alias("confidence"))


@query(f"""WITH {_PS_SQL}, hits AS (SELECT p_size AS query_id, p_partkey AS hash, 'p' || p_partkey AS path, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank FROM part QUALIFY rank < 15),
seeds AS (SELECT DISTINCT query_id, path AS id FROM hits WHERE rank < 10),
e AS (SELECT 'p' || source AS source, 's' || target AS target, weight, confidence FROM ps),
n AS (SELECT query_id, target AS id, weight * confidence AS w FROM e JOIN seeds ON source = seeds.id UNION ALL SELECT query_id, source, weight * confidence FROM e JOIN seeds ON target = seeds.id),
f AS (SELECT query_id, id, round(sum(w), 6) AS score FROM n ANTI JOIN seeds USING (query_id, id) GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS file_rank FROM f QUALIFY file_rank < 8),
b AS (SELECT 's' || l_suppkey AS path, l_orderkey * 10 + l_linenumber AS hash, l_linenumber AS start_line FROM lineitem),
b3 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, hash) - 1 AS block_rank FROM b QUALIFY block_rank < 3),
c AS (SELECT query_id, b3.hash, b3.path, score, file_rank, block_rank FROM r JOIN b3 ON r.id = b3.path ANTI JOIN hits h ON h.query_id = r.query_id AND h.hash = b3.hash QUALIFY row_number() OVER (PARTITION BY query_id, b3.hash ORDER BY file_rank, block_rank) = 1)
SELECT query_id, hash, path, score, row_number() OVER (PARTITION BY query_id ORDER BY file_rank, block_rank) - 1 AS added FROM c QUALIFY added < 24""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("hash"), F.concat(F.lit("p"), "p_partkey").alias("path"), "p_retailprice")
    hits = top(part, ["query_id"], [F.col("p_retailprice").desc(), F.col("hash")], 15, "rank").drop("p_retailprice")
    edges = part_supplier(spark, sf_dir).select(F.concat(F.lit("p"), "source").alias("source"), F.concat(F.lit("s"), "target").alias("target"), "weight", "confidence")
    blocks = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hash"), F.col("l_linenumber").alias("start_line"))
    return graph.expand(hits, blocks, edges)


@query(f"""WITH {_knn_sql(k=20)}, e AS (SELECT DISTINCT vec_id AS source, (vec_id * 7 + label) % (SELECT count(*) FROM embeddings) AS target FROM embeddings),
i AS (SELECT query_id, source, target FROM e JOIN knn a ON source = a.id JOIN knn b USING (query_id) WHERE b.id = target),
n AS (SELECT DISTINCT query_id, target AS id FROM e JOIN knn ON source = id UNION SELECT query_id, source FROM e JOIN knn ON target = id),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS num FROM n ANTI JOIN knn USING (query_id, id) QUALIFY num <= 20),
u AS (SELECT k.query_id, 100 * k.n + 50 * coalesce(i.n, 0) AS used FROM (SELECT query_id, count(*) AS n FROM knn GROUP BY 1) k LEFT JOIN (SELECT query_id, count(*) AS n FROM i GROUP BY 1) i USING (query_id))
SELECT query_id, id, true AS core FROM knn UNION ALL SELECT query_id, id, false FROM x JOIN u USING (query_id) WHERE used + 100 * num <= 3000""")
def task_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    edges = e.select(F.col("vec_id").alias("source"), ((F.col("vec_id") * 7 + F.col("label")) % n).alias("target"))
    return graph.task_subgraph(knn(e, e.where(F.col("vec_id") % EVERY == 0), 20, "vec_id", "vec_id"), edges, 3000)[0]


_DUP_SQL = "d AS (SELECT l_partkey AS source, l_suppkey AS target, 'calls' AS relation_type, round(1 - l_discount, 2) AS confidence, l_quantity AS weight, l_returnflag || l_orderkey || '-' || l_linenumber AS description FROM lineitem)"


@query(f"WITH {_DUP_SQL} SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source, target, relation_type ORDER BY confidence DESC, weight DESC, description) = 1")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_dedup(_dup(spark, sf_dir))


def _dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = F.concat("l_returnflag", "l_orderkey", F.lit("-"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("calls").alias("relation_type"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_quantity").alias("weight"), desc.alias("description"))


@query(f"WITH {_DUP_SQL} SELECT * REPLACE ('p' || source AS source, 's' || target AS target) FROM d WHERE source IN (SELECT p_partkey FROM part WHERE p_size > 25) AND target IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def dangling_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    d = _dup(spark, sf_dir).withColumns({"source": F.concat(F.lit("p"), "source"), "target": F.concat(F.lit("s"), "target")})
    return graph.without_dangling(d, ends)


@query("""WITH live AS (SELECT 'c:' || c_custkey AS id, 'symbol' AS kind, 'live' AS description FROM customer),
st AS (SELECT 'c:' || o_custkey AS id, 'symbol' AS kind, CASE WHEN max(o_totalprice) > 200000 THEN max(o_orderpriority) ELSE '' END AS description FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'f:' || s_suppkey, 'file', s_name FROM supplier)
SELECT id, live.kind, coalesce(nullif(st.description, ''), live.description) AS description FROM live LEFT JOIN st USING (id)
UNION ALL SELECT id, kind, description FROM st WHERE kind = 'file' AND id NOT IN (SELECT id FROM live)""")
def enrichment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("symbol").alias("kind"), F.lit("live").alias("description"))
    said = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c:"), "o_custkey").alias("id")).agg(F.when(F.max("o_totalprice") > 200000, F.max("o_orderpriority")).otherwise("").alias("description"))
    stored = said.select("id", F.lit("symbol").alias("kind"), "description").unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f:"), "s_suppkey").alias("id"), F.lit("file").alias("kind"), F.col("s_name").alias("description")))
    none = spark.createDataFrame([], "source string, target string")
    return graph.enrichment_merge(live, stored, none, none)[0]


# Events of a user as code: a declaration opens at every purchase, its name is the event type of the next row.
_DECL = "decl AS (SELECT event_id AS id, user_id AS path, event_type || (event_id % 7) AS name FROM events WHERE event_id % 3 = 0), uses AS (SELECT event_id AS use_id, user_id AS path, event_type || (event_id % 7) AS name FROM events WHERE event_id % 3 <> 0), imp AS (SELECT DISTINCT user_id AS path, (user_id * 3 + 1) % 150 AS imported FROM events)"
_TIER_SQL = """n AS (SELECT DISTINCT use_id, decl.id, CASE WHEN uses.path = decl.path THEN 0 WHEN imp.path IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM uses JOIN decl USING (name) LEFT JOIN imp ON imp.path = uses.path AND imp.imported = decl.path),
b AS (SELECT * FROM (SELECT use_id, tier, count(*) AS n, min(id) AS target FROM n GROUP BY use_id, tier) QUALIFY row_number() OVER (PARTITION BY use_id ORDER BY tier) = 1)"""


@query(f"WITH {_DECL}, {_TIER_SQL} SELECT use_id, target, [0.9, 0.85, 0.6][tier + 1]::double AS confidence, ['extracted', 'extracted', 'inferred'][tier + 1] AS provenance FROM b WHERE n = 1")
def scoped_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat("event_type", F.col("event_id") % 7)
    decl = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), name.alias("name"))
    uses = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("use_id"), F.col("user_id").alias("path"), name.alias("name"))
    imports = e.select(F.col("user_id").alias("path"), ((F.col("user_id") * 3 + 1) % 150).alias("imported")).distinct()
    return resolve.scoped(uses, decl, imports)


_SPANS = "spans AS (SELECT user_id, event_id AS range_id, floor(epoch(ts))::bigint AS start, floor(epoch(ts))::bigint + (3600 * (1 + event_id % 29))::bigint AS \"end\" FROM events WHERE event_type <> 'click')"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").where("event_type <> 'click'").select("user_id", F.col("event_id").alias("range_id"), at.alias("start"), (at + 3600 * (1 + F.col("event_id") % 29)).alias("end"))


@query(f"""WITH {_SPANS}, p AS (SELECT user_id, event_id AS point_id, floor(epoch(ts))::bigint AS place FROM events WHERE event_type = 'click')
SELECT point_id, range_id FROM p JOIN spans USING (user_id) WHERE start <= place AND place <= "end" QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY "end" - start, start, range_id) = 1""")
def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("point_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return resolve.smallest_enclosing(points, _spans(spark, sf_dir), "user_id", 6 * 3600)


@query(f"""WITH {_SPANS}, m AS (SELECT user_id, event_id AS id, floor(epoch(ts))::bigint AS start, floor(epoch(ts))::bigint + 7200 AS "end" FROM events)
SELECT user_id, id, start, "end", EXISTS (SELECT 1 FROM spans s WHERE s.user_id = m.user_id AND s.start <= m.start AND s."end" >= m."end" AND (s.start, s."end") <> (m.start, m."end")) AS inside,
  EXISTS (SELECT 1 FROM spans s WHERE s.user_id = m.user_id AND s.start >= m.start AND s."end" <= m."end" AND (s.start, s."end") <> (m.start, m."end")) AS has FROM m""")
def interval_inside_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    matches = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), at.alias("start"), (at + 7200).alias("end"))
    return resolve.containment(matches, _spans(spark, sf_dir), "user_id")


@query(f"""WITH {_SPANS}, c AS (SELECT user_id, floor(epoch(ts))::bigint AS line, event_type AS callee FROM events)
SELECT range_id AS function_id, array_to_string(list_sort(list_distinct(list(callee))), ',') AS calls FROM spans JOIN c USING (user_id) WHERE start <= line AND line <= "end" GROUP BY range_id""")
def calls_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("line"), F.col("event_type").alias("callee"))
    out = resolve.calls_in_range(calls, _spans(spark, sf_dir).withColumnRenamed("range_id", "function_id"), "user_id", 6 * 3600)
    return out.withColumn("calls", F.array_join("calls", ","))
