"""Queries over a source tree that is made from documents, and over graph, store and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import build_graph, fusion, graph, incremental, metrics, resolve, structural
from tessera.plans import index as ix
from tessera.plans.registry import query, table

# One Python file a document: an import of the next file, a class with a method that calls a helper, the helper.
_SRC = """src AS (SELECT doc_id AS d, 'src/m' || (doc_id % 50) || '/f' || doc_id || '.py' AS path,
  'from src.m' || ((doc_id + 1) % 50) || '.f' || (doc_id + 1) || ' import help_' || ((doc_id + 1) % 5) || ' as nxt' || chr(10) || chr(10) || 'class C' || (doc_id % 9) || ':' || chr(10) || '    def run_' || (doc_id % 7) || '(self, x):' || chr(10)
  || '        return help_' || (doc_id % 5) || '(self, nxt(x, ' || doc_id || '))' || chr(10) || chr(10) || 'def help_' || (doc_id % 5) || '(x, n):' || chr(10) || '    print("é", x)' || chr(10) || '    return n' || chr(10) AS content FROM documents)"""


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    lines = [
        F.concat(F.lit("from src.m"), (d + 1) % 50, F.lit(".f"), d + 1, F.lit(" import help_"), (d + 1) % 5, F.lit(" as nxt")), F.lit(""), F.concat(F.lit("class C"), d % 9, F.lit(":")), F.concat(F.lit("    def run_"), d % 7, F.lit("(self, x):")),
        F.concat(F.lit("        return help_"), d % 5, F.lit("(self, nxt(x, "), d, F.lit("))")), F.lit(""), F.concat(F.lit("def help_"), d % 5, F.lit("(x, n):")), F.lit('    print("é", x)'), F.lit("    return n"), F.lit(""),
    ]
    path = F.concat(F.lit("src/m"), d % 50, F.lit("/f"), d, F.lit(".py"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.concat_ws("\n", *lines).alias("content"), F.lit("python").alias("language"))


@query(f"""WITH {_SRC} SELECT path, 'C' || (d % 9) AS name, 'class' AS kind, NULL AS owner, 3 AS start_line, 5 AS end_line FROM src UNION ALL SELECT path, 'run_' || (d % 7), 'method', 'C' || (d % 9), 4, 5 FROM src
UNION ALL SELECT path, 'help_' || (d % 5), 'function', NULL, 7, 9 FROM src""")
def code_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.declarations(source_tree(spark, sf_dir))


@query(f"WITH {_SRC} SELECT path, 'run_' || (d % 7) AS name, 'method' AS kind, 'C' || (d % 9) AS owner, 4 AS start_line, 5 AS end_line FROM src WHERE d % 7 IN (1)")
def code_definitions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and a wildcard name."""
    return structural.declarations(source_tree(spark, sf_dir), ["method", "function"], "*_1").where("name LIKE 'run%'")


@query(f"""WITH {_SRC} SELECT path, 5 AS line, 15 AS "column", 'return help_2(self, nxt(x, ' || d || '))' AS text, 'C' || (d % 9) || ' › run_' || (d % 7) AS breadcrumb FROM src WHERE d % 5 = 2
UNION ALL SELECT path, 7, 4, 'def help_2(x, n): [def]', 'help_2' FROM src WHERE d % 5 = 2 UNION ALL SELECT path, 1, instr(content, 'help_2') - 1, split_part(content, chr(10), 1), NULL FROM src WHERE (d + 1) % 5 = 2""")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.references(source_tree(spark, sf_dir), "help_2").select("path", "line", "column", "text", "breadcrumb")


@query(f"""WITH {_SRC} SELECT path, 5 AS line, 15 AS "column", 'help_3(self, nxt(x, ' || d || '))' AS text, instr(content, 'help_3(self') - 1 AS start_byte FROM src WHERE d % 5 = 3 UNION ALL SELECT path, 7, 4, 'help_3(x, n)', instr(content, 'help_3(x') - 1 FROM src WHERE d % 5 = 3""")
def code_pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.search(source_tree(spark, sf_dir), "help_3($A, $B)").select("path", "line", "column", "text", "start_byte")


@query(f"""WITH {_SRC} SELECT path, 5 AS line, 'help_3(self, nxt(x, ' || d || '))' AS text FROM src WHERE d % 5 = 3""")
def code_constrained_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metavariable must match an expression."""
    return structural.search(source_tree(spark, sf_dir), "help_3($A, $B)", {"B": r"^nxt\("}).select("path", "line", "text")


@query(f"""WITH {_SRC} SELECT path, sha256(replace(content, 'print("é", x)', 'log(x, "é", 1)')) AS hash, 1 AS n FROM src""")
def code_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.rewritten(source_tree(spark, sf_dir), "print($A, $B)", "log($B, $A, 1)").select("path", F.sha2("content", 256).alias("hash"), "n")


@query(f"""WITH {_SRC}, p AS (SELECT path, 'help' AS label, 5 AS line FROM src WHERE d % 5 = 1 UNION ALL SELECT path, 'help', 7 FROM src WHERE d % 5 = 1 UNION ALL SELECT path, 'print', 8 FROM src UNION ALL SELECT path, 'next', 5 FROM src) SELECT * FROM p""")
def code_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several patterns in one pass over the files."""
    return structural.search_many(source_tree(spark, sf_dir), {"help": "help_1($A, $B)", "print": "print($$$X)", "next": "nxt($A, $N)"}).select("path", "label", "line")


@query(f"""WITH {_SRC}, m AS (SELECT path, 5 AS line, 15 AS "column" FROM src WHERE d % 5 = 3 UNION ALL SELECT path, 7, 4 FROM src WHERE d % 5 = 3), t AS (SELECT count(*) AS matches, count(DISTINCT path) AS files FROM m)
SELECT m.*, t.* FROM m, t ORDER BY contains(path, '/m3/') DESC, path, line, "column" LIMIT 15 OFFSET 5""")
def code_match_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of matches with totals, liked paths first."""
    found = structural.search(source_tree(spark, sf_dir), "help_3($A, $B)").select("path", "line", "column")
    return structural.page(found, 5, 15, ["/M3/"])


@query(f"WITH {_SRC} SELECT path, 5 AS line, 2::bigint AS in_file FROM src WHERE d % 5 = 3 UNION ALL SELECT path, 7, 2 FROM src WHERE d % 5 = 3")
def code_hits_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.count_hits(structural.search(source_tree(spark, sf_dir), "help_3($A, $B)").select("path", "line"))


@query(f"""WITH {_SRC} SELECT path, 'help_4' AS text, 4 AS matched_column FROM src WHERE d % 5 = 4""")
def code_contextual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern inside a scaffold: only the selected part counts."""
    found = structural.search_within(source_tree(spark, sf_dir), "def $NAME($$$ARGS)", "NAME")
    return found.where("text LIKE 'help_4'").select("path", "text", F.col("column").alias("matched_column"))


@query(f"""WITH {_SRC} SELECT path, fact, n FROM (SELECT path, unnest(['symbol', 'import', 'export', 'binding', 'call']) AS fact, unnest([3, 1, 2, 1, 3])::bigint AS n FROM src)""")
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, imports, exports, bindings and calls of each file."""
    return build_graph.facts(source_tree(spark, sf_dir)).groupBy("path", "fact").agg(F.count("*").alias("n"))


_HELP = "path || '::help_' || (d % 5)"
_RUN = "path || '::C' || (d % 9) || '::run_' || (d % 7)"


@query(f"""WITH {_SRC}, p AS (SELECT a.path, a.d, b.path AS n_path, b.d AS n_d FROM src a JOIN src b ON b.d = a.d + 1)
SELECT path AS source, {_HELP} AS target, 'contains' AS relation_type, 1.0::double AS confidence, 0.3::double AS weight, 'extracted' AS provenance FROM src UNION ALL SELECT path, path || '::C' || (d % 9), 'contains', 1.0, 0.3, 'extracted' FROM src UNION ALL SELECT path, {_RUN}, 'contains', 1.0, 0.3, 'extracted' FROM src
UNION ALL SELECT path, n_path, 'imports', 1.0, 0.7, 'extracted' FROM p UNION ALL SELECT {_RUN}, {_HELP}, 'calls', 0.9, 0.8, 'extracted' FROM src
UNION ALL SELECT {_RUN}, n_path || '::help_' || (n_d % 5), 'calls', 0.95, 0.8, 'extracted' FROM p""")
def code_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, imports and calls, the last by the file's own names and by names that imports bind."""
    return build_graph.build(source_tree(spark, sf_dir))[1].drop("description")


@query(f"""WITH {_SRC} SELECT path AS id, 'f' || d || '.py' AS name, 'file' AS kind, 0 AS start_line, 10 AS end_line FROM src UNION ALL SELECT path || '::C' || (d % 9), 'C' || (d % 9), 'class', 2, 4 FROM src
UNION ALL SELECT {_RUN}, 'run_' || (d % 7), 'method', 3, 4 FROM src UNION ALL SELECT {_HELP}, 'help_' || (d % 5), 'function', 6, 8 FROM src""")
def code_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_graph.build(source_tree(spark, sf_dir))[0].select("id", "name", "kind", "start_line", "end_line")


_IMPORTS = "imports AS (SELECT 'f' || n_nationkey || '.py' AS path, 'pkg.f' || ((n_nationkey * 7 + 3) % 25) AS raw, 'f' || ((n_nationkey * 7 + 3) % 25) || '.py' AS imported FROM nation UNION ALL SELECT 'f' || n_nationkey || '.py', 'util', 'f' || ((n_nationkey * 11 + 5) % 25) || '.py' FROM nation)"
_DECLS = "decl AS (SELECT DISTINCT 'f' || (p_partkey % 25) || '.py' AS path, CASE WHEN p_partkey % 3 > 0 THEN 'C' || (p_partkey % 9) END AS owner, 'm' || (p_partkey % 23) AS name, 'f' || (p_partkey % 25) || '.py::' || p_partkey AS id FROM part)"
_CALLS = "uses AS (SELECT o_orderkey AS use_id, 'f' || (o_custkey % 25) || '.py' AS path, CASE WHEN o_orderkey % 4 > 0 THEN 'C' || (o_custkey % 9) END AS owner, 'm' || (o_orderkey * 13 % 29) AS name, [NULL, 'self', 'C' || (o_orderkey % 11), 'a::$C' || (o_custkey % 11), 'f' || (o_orderkey % 25), 'util', 'nowhere', 'L' || (o_custkey % 7), NULL][o_orderkey % 9 + 1] AS qualifier FROM orders)"
_BINDS = "binds AS (SELECT DISTINCT 'f' || (s_suppkey % 25) || '.py' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'm' || (s_suppkey % 29) ELSE 'L' || (s_suppkey % 7) END AS local, CASE s_suppkey % 4 WHEN 0 THEN 'm' || (s_suppkey % 23) WHEN 1 THEN 'C' || (s_suppkey % 9) END AS real, 'f' || (s_suppkey * 3 % 25) || '.py' AS bound FROM supplier)"


@query(rf"""WITH {_IMPORTS}, {_DECLS}, {_CALLS}, {_BINDS},
u AS (SELECT *, regexp_replace(split_part(qualifier, '::', -1), '^\$+', '') AS leaf FROM uses),
b0 AS (SELECT use_id, count(DISTINCT d.id) AS n, min(d.id) AS one FROM u JOIN binds b USING (path) JOIN decl d ON d.path = b.bound WHERE (qualifier IS NULL AND local = u.name AND d.name = coalesce(real, u.name)) OR (qualifier = local AND d.name = u.name AND (real IS NULL OR real = d.owner)) GROUP BY use_id),
t1 AS (SELECT use_id, count(*) AS n, min(id) AS one FROM u JOIN decl d ON d.path = u.path AND d.owner = u.owner AND d.name = u.name WHERE leaf IN ('self', 'Self', 'this') GROUP BY use_id),
t2 AS (SELECT use_id, count(*) AS n, min(id) AS one FROM u JOIN decl d ON d.path = u.path AND d.owner = leaf AND d.name = u.name GROUP BY use_id),
t3 AS (SELECT use_id, count(*) AS n, min(id) AS one FROM u JOIN decl d ON d.owner = leaf AND d.name = u.name GROUP BY use_id),
t4 AS (SELECT use_id, count(*) AS n, min(id) AS one FROM u JOIN decl d ON d.owner = leaf AND d.name = u.name WHERE d.path IN (SELECT imported FROM imports i WHERE i.path = u.path) GROUP BY use_id),
f AS (SELECT path, name, count(*) AS n, min(id) AS one FROM decl GROUP BY ALL),
t5 AS (SELECT use_id, arg_min(one, raw || ' ' || imported) AS one FROM u JOIN imports i USING (path) JOIN f ON f.path = i.imported AND f.name = u.name AND n = 1 WHERE leaf = split_part(raw, '.', -1) OR leaf = split_part(imported, '.', 1) GROUP BY use_id),
s0 AS (SELECT use_id, n, one FROM u JOIN f USING (path, name)),
s1 AS (SELECT use_id, sum(n) AS n, min(one) AS one FROM (SELECT DISTINCT use_id, f.* FROM u JOIN imports i USING (path) JOIN f ON f.path = i.imported AND f.name = u.name AND i.imported <> u.path) GROUP BY use_id),
s2 AS (SELECT use_id, sum(n) AS n, min(one) AS one FROM u JOIN f USING (name) GROUP BY use_id),
w AS (SELECT use_id, CASE WHEN s0.n IS NOT NULL THEN CASE WHEN s0.n = 1 THEN s0.one END WHEN s1.n IS NOT NULL THEN CASE WHEN s1.n = 1 THEN s1.one END WHEN s2.n = 1 THEN s2.one END AS one,
  CASE WHEN s0.n IS NOT NULL THEN 0.9 WHEN s1.n IS NOT NULL THEN 0.85 ELSE 0.6 END AS c, CASE WHEN s0.n IS NULL AND s1.n IS NULL THEN 'inferred' ELSE 'extracted' END AS p FROM u LEFT JOIN s0 USING (use_id) LEFT JOIN s1 USING (use_id) LEFT JOIN s2 USING (use_id)),
r AS (SELECT u.use_id, CASE WHEN b0.n = 1 THEN b0.one WHEN b0.n > 1 THEN NULL WHEN qualifier IS NULL THEN w.one WHEN leaf IN ('self', 'Self', 'this') THEN CASE WHEN t1.n = 1 THEN t1.one END
    WHEN t2.n = 1 THEN t2.one WHEN t3.n = 1 THEN t3.one WHEN t4.n = 1 THEN t4.one WHEN t5.one IS NOT NULL THEN t5.one ELSE w.one END AS target,
  CASE WHEN b0.n = 1 THEN 0.95 WHEN qualifier IS NULL THEN w.c WHEN leaf IN ('self', 'Self', 'this') THEN 0.95 WHEN t2.n = 1 THEN 0.95 WHEN t3.n = 1 THEN 0.9 WHEN t4.n = 1 THEN 0.85 WHEN t5.one IS NOT NULL THEN 0.9 ELSE least(w.c, 0.65) END::double AS confidence,
  CASE WHEN b0.n = 1 THEN 'extracted' WHEN qualifier IS NULL THEN w.p WHEN leaf IN ('self', 'Self', 'this') OR t2.n = 1 OR t3.n = 1 OR t4.n = 1 OR t5.one IS NOT NULL THEN 'extracted' ELSE 'inferred' END AS provenance
  FROM u LEFT JOIN b0 USING (use_id) LEFT JOIN t1 USING (use_id) LEFT JOIN t2 USING (use_id) LEFT JOIN t3 USING (use_id) LEFT JOIN t4 USING (use_id) LEFT JOIN t5 USING (use_id) LEFT JOIN w USING (use_id))
SELECT * FROM r WHERE target IS NOT NULL""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls, parts as declarations: every tier of qualifiers."""
    f = lambda c: F.concat(F.lit("f"), c, F.lit(".py"))
    n, p, o, s = F.col("n_nationkey"), F.col("p_partkey"), F.col("o_orderkey"), F.col("s_suppkey")
    nation, cust = table(spark, sf_dir, "nation"), F.col("o_custkey")
    imports = nation.select(f(n).alias("path"), F.concat(F.lit("pkg.f"), (n * 7 + 3) % 25).alias("raw"), f((n * 7 + 3) % 25).alias("imported")).unionByName(nation.select(f(n).alias("path"), F.lit("util").alias("raw"), f((n * 11 + 5) % 25).alias("imported")))
    decl = table(spark, sf_dir, "part").select(f(p % 25).alias("path"), F.when(p % 3 > 0, F.concat(F.lit("C"), p % 9)).alias("owner"), F.concat(F.lit("m"), p % 23).alias("name"), F.concat(f(p % 25), F.lit("::"), p).alias("id"))
    said = F.array(F.lit(None).cast("string"), F.lit("self"), F.concat(F.lit("C"), o % 11), F.concat(F.lit("a::$C"), cust % 11), F.concat(F.lit("f"), o % 25), F.lit("util"), F.lit("nowhere"), F.concat(F.lit("L"), cust % 7), F.lit(None).cast("string"))
    uses = table(spark, sf_dir, "orders").select(o.alias("use_id"), f(cust % 25).alias("path"), F.when(o % 4 > 0, F.concat(F.lit("C"), cust % 9)).alias("owner"), F.concat(F.lit("m"), o * 13 % 29).alias("name"), F.element_at(said, (o % 9 + 1).cast("int")).alias("qualifier"))
    local = F.when(s % 2 == 0, F.concat(F.lit("m"), s % 29)).otherwise(F.concat(F.lit("L"), s % 7))
    real = F.when(s % 4 == 0, F.concat(F.lit("m"), s % 23)).when(s % 4 == 1, F.concat(F.lit("C"), s % 9))
    binds = table(spark, sf_dir, "supplier").select(f(s % 25).alias("path"), local.alias("local"), real.alias("real"), f(s * 3 % 25).alias("bound"))
    return resolve.calls(uses, decl, imports, binds)


# ---- operators over the driver's tables
@query("""SELECT source || '.rs' AS path, CASE WHEN doc_id % 4 = 0 THEN 'a::b<T>::Name' || doc_id WHEN doc_id % 4 = 1 THEN 'x.y.Name' || doc_id || '<A.B>' WHEN doc_id % 4 = 2 THEN '&Name' || doc_id ELSE 'Name' || doc_id END AS said, 'Name' || doc_id AS simple FROM documents WHERE doc_id % 4 <> 0
UNION ALL SELECT source || '.rs', 'a::b<T>::Name' || doc_id, 'b' FROM documents WHERE doc_id % 4 = 0""")
def simple_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    said = F.when(d % 4 == 0, F.concat(F.lit("a::b<T>::Name"), d)).when(d % 4 == 1, F.concat(F.lit("x.y.Name"), d, F.lit("<A.B>"))).when(d % 4 == 2, F.concat(F.lit("&Name"), d)).otherwise(F.concat(F.lit("Name"), d))
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".rs")).alias("path"), said.alias("said"), T.simple_type(said).alias("simple"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'run' || doc_id WHEN 1 THEN 'a.b?.run' || doc_id WHEN 2 THEN '*p->run' || doc_id WHEN 3 THEN 'S::<T>::run' || doc_id WHEN 4 THEN 'f(1).run' || doc_id ELSE 'xs[0]' END AS text FROM documents)
SELECT doc_id, text, CASE WHEN doc_id % 6 < 4 THEN 'run' || doc_id END AS name, CASE doc_id % 6 WHEN 1 THEN 'a::b' WHEN 2 THEN 'p' WHEN 3 THEN 'S' END AS qualifier FROM c""")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and qualifier of call texts; dynamic ones have neither."""
    d = F.col("doc_id")
    kinds = ["run", "a.b?.run", "*p->run", "S::<T>::run", "f(1).run"]
    text = F.when(d % 6 == 0, F.concat(F.lit(kinds[0]), d))
    for n, k in enumerate(kinds[1:], 1):
        text = text.when(d % 6 == n, F.concat(F.lit(k), d))
    text = text.otherwise("xs[0]")
    name, qualifier = T.callee(text)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), name.alias("name"), qualifier.alias("qualifier"))


@query("""SELECT doc_id, list_sort(list_distinct(['d' || (doc_id % 7) || '.md', 'sub/e' || (doc_id % 3) || '.markdown'])) AS links FROM documents""")
def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Markdown texts to other documents: no images, no external ones, anchors cut."""
    d = F.col("doc_id")
    text = F.concat(F.lit("see [a](d"), d % 7, F.lit(".md#top) and ![i](img.md) [x](https://h/y.md) [b]( sub/e"), d % 3, F.lit(".markdown ) [c](d"), d % 7, F.lit(".md) [p](z.png)\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_links(text).alias("links"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN true ELSE ['CRITICAL', 'high', 'Medium', 'LOW'][doc_id % 5] IN ('CRITICAL', 'high') END AS shown FROM documents""")
def severities_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    level = F.when(d % 5 == 1, "CRITICAL").when(d % 5 == 2, "high").when(d % 5 == 3, "Medium").when(d % 5 == 4, "LOW").otherwise("note")
    return table(spark, sf_dir, "documents").select("doc_id", T.severity_shown(level, "high").alias("shown"))


@query("""WITH s AS (SELECT doc_id, ['import_', 'use_', 'from_', 'export_', 'pub_', 'public_', ''][doc_id % 7 + 1] AS p, 'std::fs/' || lang || '.read' || doc_id AS body FROM documents)
SELECT doc_id, list_distinct([p || body, body, 'read' || doc_id]) AS candidates FROM (SELECT *, CASE WHEN p = '' THEN 1 ELSE 0 END AS z FROM s) WHERE z = 0 UNION ALL SELECT doc_id, [body, 'read' || doc_id] FROM s WHERE p = ''""".replace("list_distinct([p || body, body, 'read' || doc_id])", "[p || body, body, 'read' || doc_id]"))
def import_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by which an import is looked up: whole, without its prefix, its last part."""
    d = F.col("doc_id")
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("import_", "use_", "from_", "export_", "pub_", "public_", "")]), (d % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.import_candidates(F.concat(prefix, F.lit("std::fs/"), "lang", F.lit(".read"), d)).alias("candidates"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id + 1) || '.0.0' WHEN doc_id % 3 = 1 THEN doc_id || '.' || (doc_id % 10 + 1) || '.0' ELSE doc_id || '.' || (doc_id % 10) || '.6' END AS next FROM documents")
def version_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.next_version(F.concat(d, F.lit("."), d % 10, F.lit(".5"), F.when(d % 2 == 0, "-beta.1").otherwise("+b2")), d % 3 == 0, d % 3 == 1).alias("next"))


@query("""WITH s AS (SELECT doc_id, 'f' || doc_id AS name, lang, list_transform(range(doc_id % 5), lambda i: ['function_', 'method_', 'class_', 'struct_', 'other_'][(doc_id + i) % 5 + 1] || i) AS symbols, n_chars FROM documents),
c AS (SELECT *, len(list_filter(symbols, lambda x: contains(x, 'function_') OR contains(x, 'method_'))) AS f, len(list_filter(symbols, lambda x: contains(x, 'class_') OR contains(x, 'struct_'))) AS c FROM s)
SELECT doc_id, name || ' ' || lang || ' file' || CASE WHEN f > 0 AND c > 0 THEN ' with ' || f || ' functions and ' || c || ' classes' WHEN f > 0 THEN ' with ' || f || ' functions' WHEN c > 0 THEN ' with ' || c || ' classes' ELSE '' END || ' (' || n_chars || ' lines)' AS said FROM c""")
def simple_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("function_", "method_", "class_", "struct_", "other_")])
    symbols = F.when(d % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (d % 5 - 1).cast("int")), lambda i: F.concat(F.element_at(kinds, ((d + i) % 5 + 1).cast("int")), i)))
    return table(spark, sf_dir, "documents").select("doc_id", T.simple_description(F.concat(F.lit("f"), d), F.col("lang"), symbols, F.col("n_chars")).alias("said"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: (i + 4) || ': ' || x) AS n, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS filled FROM documents),
s AS (SELECT *, greatest(coalesce(list_position(filled, true), 0) - 1, 0) AS start FROM l)
SELECT doc_id, sha256(array_to_string(CASE WHEN length(n) <= 10 THEN n ELSE n[start + 1:start + 4] || CASE WHEN length(n) - start - 4 > 3 THEN ['... (' || (length(n) - start - 4) || ' more lines)'] || n[-3:] WHEN length(n) - start - 4 > 0 THEN n[start + 5:] ELSE [] END END, chr(10))) AS hash FROM s""")
def doc_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.doc_preview(F.col("text"), 5), 256).alias("hash"))


@query("""SELECT doc_id, sha256('# File: ' || source || CASE WHEN doc_id % 3 > 0 THEN chr(10) || '# ' || lang || CASE WHEN doc_id % 3 = 2 THEN chr(10) || '## ' || doc_id ELSE '' END ELSE '' END || chr(10) || chr(10) || text) AS hash FROM documents""")
def text_preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    context = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.concat(F.lit("# "), "lang"))).otherwise(F.array(F.concat(F.lit("# "), "lang"), F.concat(F.lit("## "), d)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.text_preamble(F.col("source"), F.col("text"), context), 256).alias("hash"))


@query("""SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier ORDER BY id LIMIT 40 OFFSET 13""")
def paginated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a table, in order."""
    return graph.page_of(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")), 13, 40)


_BLOCKS = "b AS (SELECT doc_id, source AS path, sha256(text) AS hash, [lang || '_' || (doc_id % 7), 'item' || (doc_id % 11)] AS symbols FROM documents)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.sha2("text", 256).alias("hash"), F.array(F.concat("lang", F.lit("_"), d % 7), F.concat(F.lit("item"), d % 11)).alias("symbols"))


@query(f"WITH {_BLOCKS} SELECT doc_id, 'like' AS mode FROM b WHERE regexp_matches(to_json(symbols), 'en.1') UNION ALL SELECT doc_id, 'exact' FROM b WHERE list_contains(symbols, 'en_1')")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By LIKE on the symbols' JSON text, where _ stands for any character, and by equality."""
    b = _blocks(spark, sf_dir)
    return incremental.with_symbol(b, "en_1", like=True).select("doc_id", F.lit("like").alias("mode")).unionByName(incremental.with_symbol(b, "en_1").select("doc_id", F.lit("exact").alias("mode")))


@query(f"WITH {_BLOCKS} SELECT doc_id, path, hash FROM b WHERE hash = (SELECT hash FROM b WHERE doc_id = 7) QUALIFY row_number() OVER (ORDER BY doc_id) <= 1 UNION ALL (SELECT doc_id, path, hash FROM b WHERE path = 'src7' ORDER BY hash, doc_id LIMIT 5)")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by its hash, rows by their path with a limit."""
    b = _blocks(spark, sf_dir).select("doc_id", "path", "hash")
    asked = b.where("doc_id = 7").first()["hash"]
    return incremental.by_key(b, "hash", asked, 1, "doc_id").unionByName(incremental.by_key(b, "path", "src7", 5, "hash", "doc_id"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') / count(*)::double AS rate FROM events GROUP BY user_id")
def cache_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("h"), F.count_if(F.col("event_type") != "click").alias("m"))
    return of.select("user_id", graph.hit_rate(F.col("h"), F.col("m")).alias("rate"))


@query("""WITH RECURSIVE t AS (SELECT source, doc_id, n_chars // 4 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
w(source, doc_id, n, batch, items, total) AS (SELECT source, doc_id, n, 0, 1, size FROM t WHERE n = 1 UNION ALL
SELECT t.source, t.doc_id, t.n, batch + (items >= 16 OR total >= 4000)::int, CASE WHEN items >= 16 OR total >= 4000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 16 OR total >= 4000 THEN size ELSE total + size END FROM w JOIN t ON t.source = w.source AND t.n = w.n + 1)
SELECT source, doc_id, batch FROM w""")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are full at 16 items or 4,000 tokens; a token counts four characters."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).alias("size"))
    return incremental.batches(rows, "source", "doc_id", "size", 16, 4000)


@query("""WITH c AS (SELECT c_custkey AS use_id, 'n' || c_nationkey AS path, 's' || s_suppkey AS target FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 4 = c_custkey % 4), i AS (SELECT c_custkey AS use_id, 'n' || c_nationkey AS path FROM customer WHERE c_custkey % 3 = 0),
near AS (SELECT use_id, min(target) AS target FROM c JOIN i USING (use_id, path) GROUP BY use_id HAVING count(DISTINCT target) = 1), every AS (SELECT use_id, min(target) AS target FROM c GROUP BY use_id HAVING count(DISTINCT target) = 1)
SELECT * FROM near UNION ALL SELECT * FROM every WHERE use_id NOT IN (SELECT use_id FROM near)""")
def unique_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one imported candidate, else the one of all."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("use_id"), F.concat(F.lit("n"), "c_nationkey").alias("path"), (F.col("c_custkey") % 4).alias("m"), F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("target"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 4).alias("m"))
    return resolve.one_target(c.join(s, ["n", "m"]).select("use_id", "path", "target"), c.where("use_id % 3 = 0").select("use_id", "path"))


_GRAPHS = """mn AS (SELECT 's' || s_suppkey AS id, 'p' || (s_suppkey % 10) AS path, 'main' AS kind FROM supplier), me AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey * 7 % 97 + 1) AS target, 'calls' AS relation_type FROM supplier),
bn AS (SELECT 's' || s_suppkey AS id, 'p' || (s_suppkey % 10) AS path, 'branch' AS kind FROM supplier WHERE s_suppkey % 10 IN (2, 3)), be AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey * 3 % 97 + 1) AS target, 'imports' AS relation_type FROM supplier WHERE s_suppkey % 10 = 2)"""


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    node = lambda df, kind: df.select(F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("p"), k % 10).alias("path"), F.lit(kind).alias("kind"))
    edge = lambda df, m, kind: df.select(F.concat(F.lit("s"), k).alias("source"), F.concat(F.lit("s"), k * m % 97 + 1).alias("target"), F.lit(kind).alias("relation_type"))
    return node(s, "main"), edge(s, 7, "calls"), node(s.where(k % 10 == 2).unionByName(s.where(k % 10 == 3)), "branch"), edge(s.where(k % 10 == 2), 3, "imports")


@query(f"""WITH {_GRAPHS}, n AS (SELECT * FROM mn WHERE path NOT IN ('p2', 'p4') AND id NOT IN (SELECT id FROM bn) UNION ALL SELECT * FROM bn), gone AS (SELECT id FROM mn WHERE path IN ('p2', 'p4')),
e AS (SELECT * FROM me WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) UNION ALL SELECT * FROM be)
SELECT 'node' AS part, id AS a, path AS b, kind AS c FROM n UNION ALL SELECT 'edge', source, target, relation_type FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""")
def overlay_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's graph over the main one: overridden paths go, branch nodes win, dangling edges go."""
    mn, me, bn, be = _graphs(spark, sf_dir)
    nodes, edges = graph.merge_overlay((mn, me), (bn, be), spark.createDataFrame([("p2",), ("p4",)], "path string"))
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("path").alias("b"), F.col("kind").alias("c")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation_type").alias("c")))


@query(f"""WITH {_GRAPHS}, gone AS (SELECT id FROM mn WHERE path IN ('p1', 'p7'))
SELECT 'node' AS part, id AS a FROM mn WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', source || '>' || target FROM me WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)""")
def graph_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    mn, me, _, _ = _graphs(spark, sf_dir)
    nodes, edges = graph.purge(mn, me, spark.createDataFrame([("p1",), ("p7",)], "path string"))
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a")).unionByName(edges.select(F.lit("edge").alias("part"), F.concat("source", F.lit(">"), "target").alias("a")))


@query("""WITH n AS (SELECT 'src/m' || (s_suppkey % 7) || '/f' || s_suppkey || '.rs' AS f, s_suppkey AS k FROM supplier)
SELECT './' || f AS text, f AS id FROM n UNION ALL SELECT upper('f' || k || '.rs'), f FROM n UNION ALL SELECT 'only_' || k, f || '::S::only_' || k FROM n UNION ALL SELECT 'S::only_' || k, f || '::S::only_' || k FROM n UNION ALL SELECT f, f FROM n""")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node ids by what a user may write; names that several nodes share find none."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("f", F.concat(F.lit("src/m"), k % 7, F.lit("/f"), k, F.lit(".rs")))
    nodes = s.select(F.explode(F.array("f", F.concat("f", F.lit("::S::only_"), k), F.concat("f", F.lit("::run")))).alias("id"))
    asked = s.select(F.explode(F.array(F.col("f"), F.concat(F.lit("./"), "f"), F.upper(F.concat(F.lit("f"), k, F.lit(".rs"))), F.concat(F.lit("only_"), k), F.concat(F.lit("S::only_"), k), F.lit("run"), F.lit("nothing"))).alias("text")).distinct()
    return graph.resolve_id(nodes, asked).select("text", "id")


@query("""SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 >= 2 OR s_suppkey % 60 >= 50 OR s_suppkey % 5 >= 3""")
def nodes_to_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    some = lambda n: F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("x"), n.cast("int")))
    return graph.worth_describing(table(spark, sf_dir, "supplier").select(k.alias("id"), some(k % 4).alias("exports"), (k % 60).alias("size_lines"), some(k % 5).alias("symbols"))).select("id")


@query("""WITH i AS (SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'markdown' ELSE 'rust' END AS language, 'use a::item' || (c_custkey % 9) AS name, 's' || (c_custkey % 90 + 1) AS target FROM customer), x AS (SELECT 's' || s_suppkey AS target, 'item' || (s_suppkey % 9) AS export FROM supplier)
SELECT path AS source, target, CASE WHEN language = 'markdown' THEN 'references' ELSE 'imports' END AS relation_type, 0.95::double AS confidence, 1.0::double AS weight FROM i UNION ALL SELECT DISTINCT target, path, 'exports', 0.9::double, 0.8::double FROM i JOIN x USING (target) WHERE contains(name, export)""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of resolved imports, and back where an export is part of the import text."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    imports = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c).alias("path"), F.when(c % 4 == 0, "markdown").otherwise("rust").alias("language"), F.concat(F.lit("use a::item"), c % 9).alias("name"), F.concat(F.lit("s"), c % 90 + 1).alias("target"))
    return ix.direct_import_edges(imports, table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s).alias("path"), F.concat(F.lit("item"), s % 9).alias("name")))


@query("""WITH f AS (SELECT s_suppkey AS k, ['go', 'python', 'php'][s_suppkey % 3 + 1] AS language, 'd' || (s_suppkey % 6) AS dir, CASE WHEN s_suppkey % 3 = 1 AND s_suppkey % 6 = 1 AND s_suppkey < 7 THEN '__init__' ELSE 'f' || s_suppkey END AS stem FROM supplier),
p AS (SELECT *, dir || '/' || stem || ['.go', '.py', '.php'][k % 3 + 1] AS path FROM f)
SELECT path AS source, 'folder:' || language || ':' || dir AS target, 'sibling_module' AS relation_type, 0.8::double AS confidence FROM p WHERE language <> 'python' UNION ALL SELECT h.path, p.path, 'parent_module', 0.8::double FROM p h JOIN p ON p.dir = h.dir AND p.language = h.language WHERE h.stem = '__init__' AND h.path <> p.path""")
def layout_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by folders: heads of packages to the files below, files to their folder."""
    k = F.col("s_suppkey")
    lang = F.element_at(F.array(F.lit("go"), F.lit("python"), F.lit("php")), (k % 3 + 1).cast("int"))
    ext = F.element_at(F.array(F.lit(".go"), F.lit(".py"), F.lit(".php")), (k % 3 + 1).cast("int"))
    stem = F.when((k % 3 == 1) & (k % 6 == 1) & (k < 7), "__init__").otherwise(F.concat(F.lit("f"), k))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k % 6, F.lit("/"), stem, ext).alias("path"), lang.alias("language"))
    return build_graph.layout_edges(files).select("source", "target", "relation_type", "confidence")


@query("""WITH e AS (SELECT DISTINCT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer) SELECT target, source FROM e WHERE target IN ('n3', 'n4', 'n5', 'n6', 'n7') QUALIFY row_number() OVER (PARTITION BY target ORDER BY source) <= 5""")
def consumers_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    return ix.consumers([f"n{k}" for k in range(3, 11)], edges)


@query("""WITH a AS (SELECT user_id AS path FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_id % 7 = 0), d AS (SELECT DISTINCT user_id AS path FROM events WHERE user_id % 11 = 0)
SELECT path, 'index' AS what FROM a WHERE path NOT IN (SELECT path FROM d) UNION ALL SELECT path, 'hide' FROM (SELECT path FROM a UNION SELECT path FROM d)""")
def branch_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a branch indexes and what it hides of the main index."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "event_type", "event_id")
    todo, hidden = incremental.overridden(e.where("event_type = 'click'"), e.where("event_id % 7 = 0"), e.where("path % 11 = 0").select("path").distinct())
    return todo.select("path", F.lit("index").alias("what")).unionByName(hidden.select("path", F.lit("hide").alias("what")))


@query("""WITH i AS (SELECT DISTINCT user_id AS path FROM events), d AS (SELECT DISTINCT user_id AS path FROM events WHERE event_type = 'error' AND value > 20), g AS (SELECT DISTINCT user_id AS path FROM events WHERE user_id % 13 = 0)
SELECT path FROM i WHERE path NOT IN (SELECT path FROM d) OR path IN (SELECT path FROM g)""")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed paths that are gone, or ignored now."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "event_type", "value")
    return incremental.missing(e, e.where("event_type = 'error' AND value > 20").select("path").distinct(), e.where("path % 13 = 0").select("path").distinct())


@query("""SELECT doc_id::varchar AS query, 'src/' || source || ':x.rs' AS path, (doc_id % 40)::int AS t_start, (doc_id % 40 + 5)::int AS t_end, (1 + doc_id % 3)::double AS grade FROM documents UNION ALL SELECT doc_id::varchar, lang, 3, 9, 0.5::double FROM documents WHERE doc_id % 2 = 0""")
def parsed_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth cells of the form path:start-end:grade; other cells are left out."""
    d = F.col("doc_id")
    cells = table(spark, sf_dir, "documents").select(d.cast("string").alias("query"), F.concat(F.lit("src/"), "source", F.lit(":x.rs:"), d % 40, F.lit("-"), d % 40 + 5, F.lit(":"), 1 + d % 3).alias("a"), F.when(d % 2 == 0, F.concat("lang", F.lit(":3-9:0.5"))).otherwise("no truth").alias("b"))
    return metrics.parse_truths(cells, ["a", "b"])


@query("""WITH l AS (SELECT 'd' || doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 1)::int AS rank FROM documents WHERE doc_id % 40 = 0), s AS (SELECT 'd' || doc_id AS id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1)::int AS rank FROM documents)
SELECT id, 0 AS origin, rank FROM l UNION ALL SELECT id, 1, rank FROM s WHERE id NOT IN (SELECT id FROM l) ORDER BY origin, rank, id LIMIT 50""")
def composed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits first, semantic ones behind them."""
    from pyspark.sql import Window

    place = lambda df, *by: df.select(F.concat(F.lit("d"), "doc_id").alias("id"), (F.row_number().over(Window.orderBy(*by)) - 1).alias("rank"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ix.search_composition(place(docs.where("doc_id % 40 = 0"), "doc_id"), place(docs, F.col("n_chars").desc(), "doc_id"))


@query("""WITH n AS (SELECT event_id AS id, ((event_id * 37) % 100 / 100.0)::double AS sim, event_type = 'click' AS direct, event_id % 9 = 0 AS described FROM events)
SELECT id, CASE WHEN direct THEN greatest(sim, 0.9) ELSE sim END::double AS score FROM n WHERE direct OR described OR sim > 0.6""")
def boosted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text hit lifts a node's similarity, one in the description lets it in."""
    i = F.col("event_id")
    score, keep = graph.boosted(i * 37 % 100 / 100.0, F.col("event_type") == "click", i % 9 == 0, 0.6)
    return table(spark, sf_dir, "events").where(keep).select(i.alias("id"), score.alias("score"))


@query("""WITH b AS (SELECT doc_id AS hash, source AS path, doc_id::int AS start_line, ['fn_' || (doc_id % 30), '_hid' || (doc_id % 5), 'T' || (doc_id % 17)] AS symbols FROM documents), h AS (SELECT * FROM b WHERE doc_id % 50 = 0) , s AS (SELECT DISTINCT unnest(symbols) AS symbol FROM h), k AS (SELECT symbol FROM s WHERE regexp_matches(symbol, '^[A-Za-z]')),
f AS (SELECT hash, path, start_line, symbol FROM (SELECT hash, path, start_line, unnest(symbols) AS symbol FROM b) JOIN k USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY path, start_line, hash) = 1)
SELECT hash, path, start_line, count(*) AS shared FROM f WHERE hash NOT IN (SELECT hash FROM h) GROUP BY ALL""".replace("WHERE doc_id % 50 = 0", "WHERE hash % 50 = 0"))
def symbol_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that declare what the hits name."""
    from tessera.plans.search import expand_symbols

    d = F.col("doc_id")
    b = table(spark, sf_dir, "documents").select(d.alias("hash"), F.col("source").alias("path"), d.cast("int").alias("start_line"), F.array(F.concat(F.lit("fn_"), d % 30), F.concat(F.lit("_hid"), d % 5), F.concat(F.lit("T"), d % 17)).alias("symbols"))
    return expand_symbols(b.where("hash % 50 = 0"), b)


@query("""SELECT 'region' AS kind, false AS needed UNION ALL SELECT 'empty', true UNION ALL SELECT 'missing', true""")
def graph_needs_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    rows = [("region", graph.needs_indexing(r, r)), ("empty", graph.needs_indexing(r, r.where("r_regionkey < 0"))), ("missing", graph.needs_indexing(None, r))]
    return spark.createDataFrame(rows, "kind string, needed boolean")


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE substr(text, 1, 150) || chr(10) || '...' || chr(10) || right(text, 150) END AS sample FROM documents
QUALIFY sum(n_chars // 4 + 50) OVER (PARTITION BY source ORDER BY doc_id % 7 DESC, doc_id ROWS UNBOUNDED PRECEDING) - 50 < 3000""")
def content_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a file for a description, most symbols first, while their tokens fit; long ones by both ends."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.floor(F.col("n_chars") / 4).alias("tokens"), (F.col("doc_id") % 7).alias("n"))
    return incremental.content_sample(rows, ["source"], [F.col("n").desc(), F.col("doc_id")], "text", "tokens", 3000).select("doc_id", "sample")


@query("""WITH p AS (SELECT 'a' AS s, ['a', 'n' || n_nationkey, 'r' || n_regionkey] AS path FROM nation), e AS (SELECT 'a' AS source, 'n' || n_nationkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'calls' ELSE 'imports' END AS relation FROM nation WHERE n_nationkey % 5 > 0)
SELECT path[1] || ' -' || coalesce(e.relation, '?') || '-> ' || path[2] || ' -part_of-> ' || path[3] AS text FROM p LEFT JOIN e ON e.target = path[2]""")
def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as text with the relation of each hop; unknown ones as a question mark."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    edges = n.where("k % 5 > 0").select(F.lit("a").alias("source"), F.col("n").alias("target"), F.when(F.col("k") % 2 == 0, "calls").otherwise("imports").alias("relation_type"))
    edges = edges.unionByName(n.select(F.col("n").alias("source"), F.col("r").alias("target"), F.lit("part_of").alias("relation_type")))
    return ix.rendered_paths(n.select(F.lit("a").alias("source"), F.col("r").alias("target"), F.array(F.lit("a"), "n", "r").alias("path")), edges).select("text")


@query("""WITH r AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS s FROM embeddings WHERE label <> 9)
SELECT vec_id AS hash, round(s * CASE WHEN label IN (1, 2) THEN 1.5 ELSE 1 END, 6) AS score FROM r WHERE round(s * CASE WHEN label IN (1, 2) THEN 1.5 ELSE 1 END, 6) > 0.2""")
def concept_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks near a query; symbols that are concepts count half as much again."""
    e = table(spark, sf_dir, "embeddings")
    asked = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    rows = e.select(F.col("vec_id").alias("hash"), F.concat(F.lit("p"), "label").alias("path"), F.array(F.concat(F.lit("L"), "label")).alias("symbols"), "embedding")
    paths = e.where("label <> 9").select(F.concat(F.lit("p"), "label").alias("path")).distinct()
    return ix.snippets(rows, paths, asked, spark.createDataFrame([("l1",), ("l2",)], "concept string"), 0.2).select("hash", "score")
