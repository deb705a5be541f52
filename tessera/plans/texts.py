"""Text, path, incremental and streaming-like queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.functions.rows import computed
from tessera.operators import chunks, incremental, structural
from tessera.plans.registry import query, table


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.hrefs(F.col("html"))).alias("href"))


_RAW = "'a/./' || page_id || '/../' || (page_id % 7) || '//' || regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


@query(f"""WITH RECURSIVE r AS (SELECT page_id, {_RAW} AS raw, list_filter(string_split({_RAW}, '/'), lambda p: p NOT IN ('', '.')) AS p FROM pages),
w(page_id, raw, p, i, acc) AS (SELECT page_id, raw, p, 1, []::VARCHAR[] FROM r UNION ALL
SELECT page_id, raw, p, i + 1, CASE WHEN p[i] <> '..' THEN list_append(acc, p[i]) WHEN length(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] ELSE list_append(acc, p[i]) END FROM w WHERE i <= length(p))
SELECT page_id, raw, array_to_string(acc, '/') AS path FROM w WHERE i > length(p)""")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("a/./"), "page_id", F.lit("/../"), F.col("page_id") % 7, F.lit("//"), F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), T.normalise_path(raw).alias("path"))


@query("SELECT doc_id, sha256(text || source || '0' || n_chars) AS hash FROM documents")
def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.block_hash("text", "source", F.lit("0"), "n_chars").alias("hash"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative for each content."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH l AS (SELECT 'd' || lpad(doc_id::varchar, 9, '0') AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, length(string_split(text, chr(10))) + 1))::int AS line FROM documents),
c AS (SELECT path, line, strlen(substr(text, 1, instr(text, 'the') - 1))::int AS "column", text FROM l WHERE contains(text, 'the') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 20)
SELECT * FROM c ORDER BY path, line, "column" LIMIT 200""")
def lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a token with the byte column of its first place: 20 a file and 200 in all, as the operator has it."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.lpad("doc_id", 9, "0")).alias("path"), F.col("text").alias("content"))
    return structural.lexical(files, "the")


@query("SELECT doc_id FROM documents WHERE contains(text, 'thin') AND contains(text, 'the') AND contains(text, 'and')")
def prefilter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap literal tests before an expensive parse: the identifiers of a pattern without its metavariables."""
    return table(spark, sf_dir, "documents").where(T.has_all(F.col("text"), T.prefilter_tokens("the($A, and) = thin $$$REST"))).select("doc_id")


_ENRICHED = "'# File: ' || source || chr(10) || '# Language: ' || lang || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '# Defines: ' || lang || ', ' || source ELSE '' END || chr(10) || chr(10) || text"


def _enriched() -> F.Column:
    names = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return T.code_preamble(F.col("source"), F.col("lang"), names, F.col("text"))


@query(f"SELECT doc_id, sha256({_ENRICHED}) AS hash, length({_ENRICHED})::int AS n FROM documents")
def enriched_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("e", _enriched()).select("doc_id", F.sha2("e", 256).alias("hash"), F.length("e").alias("n"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def preamble_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripping undoes adding."""
    return table(spark, sf_dir, "documents").withColumn("e", _enriched()).select("doc_id", F.sha2(T.strip_preamble(F.col("e")), 256).alias("hash"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: i || ': ' || x) AS n FROM documents)
SELECT doc_id, sha256(CASE WHEN length(n) <= 10 THEN array_to_string(n, chr(10)) ELSE array_to_string(n[:4] || ['... (' || (length(n) - 7) || ' more lines)'] || n[-3:], chr(10)) END) AS hash FROM l""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.preview(F.col("text")), 256).alias("hash"))


@query(r"""SELECT doc_id, text <> '' AND NOT contains(text, chr(0)) AND length(regexp_replace(text, '[^\x20-\x7E\n\r\t]', '', 'g')) / strlen(text) > 0.8 AS is_text FROM documents""")
def text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_like_text(F.col("text")).alias("is_text"))


_EXTS = ["rs", "py", "md", "toml", "xyz", "h", "TS", "c++", "ixx", "gitignore", "NOTES", "bib", "lua"]
_PATH = "'/src/' || source || CASE WHEN doc_id % 5 = 0 THEN '/tests/' ELSE '/' END || doc_id || '.' || [" + ", ".join(f"'{e}'" for e in _EXTS) + f"][doc_id % {len(_EXTS)} + 1]"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), m AS (SELECT * FROM (VALUES ('rs', 'rust'), ('py', 'python'), ('md', 'markdown'), ('h', 'cpp'), ('xyz', 'python'), ('c++', 'cpp'), ('ixx', 'cpp'), ('lua', 'lua')) AS m(ext, language))
SELECT doc_id, path, language, CASE WHEN contains(path, '/tests/') THEN 'test_file' WHEN path LIKE '%.md' THEN 'documentation' ELSE 'source_file' END AS kind, lower(regexp_extract(path, '[.]([^.]+)$', 1)) IN ('toml', 'md', 'notes') AS is_text,
  regexp_matches(path, '^/src/[^/]*/tests/.*[.][rp][^/]$') AS in_glob FROM p LEFT JOIN m ON ext = regexp_extract(path, '[.]([^.]+)$', 1)""")
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language with a project override, file kind, text allow-list and a glob."""
    middle = F.when(F.col("doc_id") % 5 == 0, "/tests/").otherwise("/")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/src/"), "source", middle, "doc_id", F.lit("."), ext).alias("path"))
    p = F.col("path")
    return rows.select("doc_id", "path", T.language(p, {"*.xyz": "python"}).alias("language"), T.file_kind(p).alias("kind"), T.is_text_name(p).alias("is_text"), T.path_matches(p, "/src/*/tests/**.[rp]?").alias("in_glob"))


_COMMIT = "CASE turn % 4 WHEN 0 THEN 'feat(' || role || '): ' WHEN 1 THEN 'fix: ' WHEN 2 THEN 'chore!: ' ELSE 'add ' END || text"


@query(rf"""WITH c AS (SELECT conv_id, turn, {_COMMIT} AS m FROM conversations), l AS (SELECT *, string_split(m, chr(10))[1] AS line FROM c),
e AS (SELECT conv_id, turn, m, line, regexp_extract(line, '^(\w+)(?:\(([^)]*)\))?(!)?:\s*(.*)$', ['t', 's', 'b', 'd']) AS x FROM l),
f AS (SELECT conv_id, turn, CASE WHEN x.t <> '' THEN lower(x.t) WHEN lower(regexp_extract(line, '^(\w+)', 1)) IN ('add', 'added', 'adds', 'feature', 'implement') THEN 'feat' ELSE 'other' END AS type,
  nullif(x.s, '') AS scope, x.b = '!' OR contains(m, 'BREAKING CHANGE') AS breaking, CASE WHEN x.t <> '' THEN x.d ELSE line END AS description FROM e)
SELECT *, CASE WHEN breaking THEN 'breaking' WHEN type IN ('feat', 'fix') THEN type ELSE 'other' END AS category FROM f""")
def conventional_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commit messages: the form, its parts and their category."""
    head = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("feat("), "role", F.lit("): "))).when(F.col("turn") % 4 == 1, "fix: ").when(F.col("turn") % 4 == 2, "chore!: ").otherwise("add ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("m"))
    rows = rows.select("conv_id", "turn", *[c.alias(k) for k, c in T.conventional(F.col("m")).items()])
    return rows.withColumn("category", T.category(F.col("type"), F.col("breaking")))


@query("""WITH o AS (SELECT user_id AS path, event_type || event_id AS hash FROM events WHERE event_id % 10 < 8), n AS (SELECT user_id AS path, event_type || event_id AS hash FROM events WHERE event_id % 10 > 1)
SELECT coalesce(o.path, n.path) AS path, coalesce(o.hash, n.hash) AS hash, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' ELSE 'keep' END AS action FROM o FULL JOIN n ON o.path = n.path AND o.hash = n.hash""")
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.concat("event_type", "event_id").alias("hash"), (F.col("event_id") % 10).alias("m"))
    return incremental.hash_diff(rows.where("m < 8"), rows.where("m > 1"), ["path", "hash"])


_FILES = "f AS (SELECT user_id AS path, max(floor(epoch(ts))::bigint) AS mtime FROM events GROUP BY 1), m AS (SELECT user_id AS path, max(floor(epoch(ts))::bigint) AS mtime FROM events WHERE user_id % 3 > 0 AND event_type <> 'error' GROUP BY 1)"


@query(f"WITH {_FILES} SELECT f.path, f.mtime FROM f LEFT JOIN m USING (path) WHERE m.mtime IS NULL OR f.mtime > m.mtime")
def mtime_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    files = e.groupBy("path").agg(F.max("t").alias("mtime"))
    known = e.where("path % 3 > 0 AND event_type <> 'error'").groupBy("path").agg(F.max("t").alias("mtime"))
    return incremental.changed(files, known)


@query("SELECT user_id AS path, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "event_id", "event_type", "value", "ts")
    return incremental.latest(e, ["path"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query("""WITH gone AS (SELECT c_custkey AS path FROM customer WHERE c_acctbal < 0)
SELECT 'orders' AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'customer', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_custkey NOT IN (SELECT path FROM gone)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("path"))
    left = incremental.cascade_delete({"orders": orders.withColumnRenamed("o_custkey", "path"), "customer": customer.withColumnRenamed("c_custkey", "path")}, gone)
    total = lambda name, c: left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(c), 2).alias("total"))
    return total("orders", "o_totalprice").unionByName(total("customer", "c_acctbal"))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, floor(epoch(min(ts)))::bigint AS first, floor(epoch(max(ts)))::bigint AS last, count(*) AS n FROM s GROUP BY user_id, s.n""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of a path until six hours of quiet."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("a").alias("first"), F.unix_timestamp("b").alias("last"), "n")


_TABLES = ["documents", "pages", "conversations", "embeddings", "lineitem", "orders"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, CASE WHEN count(*) < 1000 THEN NULL ELSE greatest(2, least(1024, floor(sqrt(count(*)))::int)) END AS partitions FROM {t}" for t in _TABLES))
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and what a vector index over each table would have as partitions, by the root at every size."""
    rows = [(t, n, incremental.index_params(n, always_root=True)) for t in _TABLES for n in [table(spark, sf_dir, t).count()]]
    return spark.createDataFrame(rows, "name string, rows long, partitions int")


@query("SELECT DISTINCT source AS path FROM documents UNION SELECT DISTINCT url FROM pages UNION SELECT DISTINCT role FROM conversations")
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (("documents", "source"), ("pages", "url"), ("conversations", "role"))
    return incremental.distinct_paths([table(spark, sf_dir, t).select(F.col(c).alias("path")) for t, c in names])


@query(r"""WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents UNION SELECT lang, unnest(['another', 'thought', 'learn_it', 'through', '__where__', 'plants', 'a_b', '(another)']) FROM documents),
b AS (SELECT lang, word, regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS bare FROM w)
SELECT lang, word FROM b WHERE (strlen(bare) > 6 OR contains(bare, '_')) AND bare NOT IN ('about', 'after', 'again', 'below', 'could', 'every', 'first', 'found', 'great', 'house', 'large', 'learn', 'never', 'other', 'place', 'plant', 'point', 'right', 'small', 'sound', 'spell', 'still', 'study', 'their', 'there', 'these', 'thing', 'think', 'three', 'water', 'where', 'which', 'world', 'would', 'write')""")
def technical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.rows import tokens

    docs = table(spark, sf_dir, "documents").select("lang", "text")
    more = docs.select("lang", F.explode(F.array(*[F.lit(w) for w in ("another", "thought", "learn_it", "through", "__where__", "plants", "a_b", "(another)")])).alias("word"))
    words = computed(docs, w=tokens("text")).select("lang", F.explode("w").alias("word")).unionByName(more).distinct()
    return words.where(T.is_technical(F.col("word")))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text", chunks.text_chunks, config.CHUNK_BYTES, 2)


@query()
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a header a turn, the level by role."""
    level = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("### ")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(level, "role", F.lit("\n"), "text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return chunks.markdown_table(rows, "conv_id", "text")
