"""Indexing end to end: full and incremental runs, branch overlays, commits. Markers are written last."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import block_hash, code_preamble, text_preamble
from tessera.operators import build_graph, graph, incremental
from tessera.operators.blocks import blocks, embedded
from tessera.sources import files as src
from tessera.sources.store import Store, branch_manifest

TABLE_OF = {"code": "code_blocks", "text": "text_blocks", "document": "document_blocks"}


def enriched(rows: DataFrame) -> DataFrame:
    """Blocks embedded with their preamble: the stored content stays as it is."""
    names = F.coalesce("symbols", F.array().cast("array<string>"))
    text = F.when(F.col("modality") == "code", code_preamble(F.col("path"), F.coalesce("language", F.lit("")), names, F.col("content"))).otherwise(text_preamble(F.col("path"), F.col("content"), F.coalesce("context", F.array().cast("array<string>"))))
    return embedded(rows.withColumn("_text", text), "_text").drop("_text").withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))


def write_blocks(store: Store, files: DataFrame) -> dict[str, int]:
    """Differential by hash: new blocks are embedded and appended, stale ones of these files deleted, the rest is left alone."""
    rows, counts = blocks(files).persist(), {}
    paths = files.select("path").distinct()
    for modality, name in TABLE_OF.items():
        new, old = rows.where(F.col("modality") == modality), store.read(name)
        diff = incremental.hash_diff(old.join(paths, "path", "left_semi"), new, ["path", "hash"])
        gone, fresh = diff.where("action = 'delete'").select("path", "hash"), diff.where("action = 'insert'").select("path", "hash")
        counts[name], stale = fresh.count(), not gone.isEmpty()
        add = enriched(new.join(fresh, ["path", "hash"], "left_semi").dropDuplicates(["path", "hash"]))
        if stale:  # one new state holds both changes; only the buckets of these files are written
            store.delete(name, gone, ["path", "hash"], add.select(*old.columns))
        elif counts[name]:
            store.append(name, add)
    rows.unpersist()
    return counts


def write_graph(store: Store, files: DataFrame) -> None:
    nodes, edges = build_graph.build(files)
    full = nodes.withColumns({"description": F.lit(""), "hash": F.sha2(F.concat("id", "path"), 256), "size_lines": F.col("end_line") - F.col("start_line") + 1, **{c: F.lit(None) for c in ("symbols", "imports", "exports", "functions", "embedding")}})
    store.replace("graph_nodes", full)
    store.replace("graph_edges", edges)


def index(store: Store, root: str, head: str | None = None, now: int | None = None) -> dict[str, int]:
    """Index a tree. With an unchanged head only files that are gone are cleaned up; else files newer than their stored time are read."""
    spark, now = store.spark, now if now is not None else int(time.time())
    files = src.source_files(spark, root).persist()
    gone = incremental.missing(incremental.distinct_paths([store.read(t) for t in TABLE_OF.values()]), files.select("path"))
    if not gone.isEmpty():
        store.cascade(gone)
    if head is not None and store.marker("files") == head:
        return dict.fromkeys(TABLE_OF.values(), 0)
    todo = incremental.changed(files, store.read("file_metadata"))
    counts = write_blocks(store, todo)
    store.upsert_metadata(todo.select("path", "mtime", F.lit(now).cast("bigint").alias("indexed_at")))
    write_graph(store, files)
    if head is not None:
        store.set_marker("files", head, now)
        store.set_marker("graph", head, now)
    files.unpersist()
    return counts


def reindex_file(store: Store, root: str, changed: DataFrame, deleted: DataFrame) -> None:
    """Handler for change feeds: cascade both, then read the changed ones again."""
    store.cascade(changed.select("path").unionByName(deleted.select("path")).distinct())
    files = src.source_files(store.spark, root).join(changed.select("path"), "path", "left_semi")
    write_blocks(store, files)
    store.upsert_metadata(files.select("path", "mtime", F.lit(int(time.time())).cast("bigint").alias("indexed_at")))


def index_commits(store: Store, root: str, branch: str = "HEAD") -> int:
    """Commits behind the marker, each embedded with its message and files."""
    rows = src.commits(store.spark, root, branch, store.marker("commits"))
    n = rows.count()
    if n:
        body = F.concat_ws("\n", F.concat(F.lit("Commit: "), F.col("message")), F.concat(F.lit("Files: "), F.array_join("files", ", ")))
        out = embedded(rows.withColumn("content", body), "content").withColumn("description", F.lit("")).withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))
        store.append("commit_blocks", out)
        store.set_marker("commits", src.resolve_ref(root, branch), int(time.time()))
    return n


# branches
def index_branch(main: Store, root: str, branch: str, base: str) -> dict:
    """Delta index of the files that differ from the fork point, and its manifest."""
    fork = src.merge_base(root, base, "HEAD")
    names = sorted({*src.changed_since(root, fork), *src.all_changed(root)})
    files = src.source_files(main.spark, root)
    present = {r.path for r in files.select("path").where(F.col("path").isin(names)).collect()}
    delta = Store(main.spark, main.base, branch)
    delta.drop("all")
    write_blocks(delta, files.where(F.col("path").isin(sorted(present))))
    manifest = branch_manifest(branch, base, fork, src.resolve_ref(root, "HEAD") or "", sorted(present), sorted(set(names) - present), main.marker("files") or "", int(time.time()))
    delta._write(f"{delta.root}/../manifest.json".replace("/storage/..", ""), json.dumps(manifest))
    return manifest


def manifest_of(main: Store, branch: str) -> dict | None:
    delta = Store(main.spark, main.base, branch)
    text = delta._read(f"{delta.root}/../manifest.json".replace("/storage/..", ""))
    return json.loads(text) if text else None


def overlay_of(main: Store, branch: str) -> tuple[DataFrame, DataFrame] | None:
    """(delta blocks, overridden paths) where the branch index fits the main one."""
    m = manifest_of(main, branch)
    if m is None or not incremental.coherent(m["base_db_commit"], main.marker("files")):
        return None
    hidden = main.spark.createDataFrame([(p,) for p in sorted({*m["changed_paths"], *m["deleted_paths"]})], "path string")
    return all_blocks(Store(main.spark, main.base, branch)), hidden


def all_blocks(store: Store) -> DataFrame:
    """One table of blocks for search."""
    out = None
    for modality, name in TABLE_OF.items():
        df = store.read(name)
        part = df.select("path", F.lit(modality).alias("modality"), F.col("language") if "language" in df.columns else F.lit("markdown").alias("language"), "content", F.col("symbols") if "symbols" in df.columns else F.lit(None).cast("array<string>").alias("symbols"), "start_line", "end_line", "hash", "embedding")
        out = part if out is None else out.unionByName(part)
    return out


def branches(main: Store) -> list[str]:
    at = main.path(f"{main.base}/branches")
    return sorted(s.getPath().getName().replace("--", "/") for s in main.fs.listStatus(at)) if main.fs.exists(at) else []


def delete_branch(main: Store, branch: str) -> None:
    main.fs.delete(main.path(f"{main.base}/branches/{branch.replace('/', '--')}"), True)


def prune_branches(main: Store, root: str, base: str) -> list[str]:
    """Delete delta indexes of branches that are gone or merged into base."""
    gone = [b for b in branches(main) if (ref := src.resolve_ref(root, b)) is None or src.commits_ahead(root, base, ref) == 0]
    for b in gone:
        delete_branch(main, b)
    return gone


# graph facts of files
def file_nodes(rows: DataFrame) -> DataFrame:
    """Per file: sorted distinct symbols, last line and the hash of its contents in order, with the path."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"), F.max("end_line").alias("size_lines"), block_hash(joined, "path").alias("hash"))


def siblings(rows: DataFrame) -> DataFrame:
    """Symbols of each path in order of appearance."""
    return rows.groupBy("path").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "symbols"))), lambda x: x["symbols"]))).alias("symbols"))


def key_concepts(nodes: DataFrame) -> DataFrame:
    """concept, weight: names 1, kinds 0.8, technical words of descriptions 0.5; the greatest counts."""
    from tessera.functions.rows import tokens
    from tessera.functions.text import is_technical

    words = nodes.select(F.explode(tokens("description")).alias("concept")).where(is_technical(F.col("concept"))).withColumn("weight", F.lit(0.5))
    named = nodes.select(F.lower("name").alias("concept"), F.lit(1.0).alias("weight")).unionByName(nodes.select(F.lower("kind").alias("concept"), F.lit(0.8).alias("weight")))
    return named.unionByName(words).groupBy("concept").agg(F.max("weight").alias("weight"))


def snippets(rows: DataFrame, paths: DataFrame, query: F.Column, concepts: DataFrame, least: float = 0.5) -> DataFrame:
    """Blocks of the subgraph's files, similarity half as much again where a symbol is a concept, above `least`."""
    from tessera.functions.vector import cosine_similarity

    named = rows.select("hash", F.explode("symbols").alias("s")).select("hash", F.lower("s").alias("concept")).join(concepts.select("concept"), "concept", "left_semi").select("hash").distinct().withColumn("named", F.lit(1.5))
    out = rows.join(paths, "path", "left_semi").join(named, "hash", "left")
    return out.withColumn("score", F.round(cosine_similarity(F.col("embedding"), query) * F.coalesce("named", F.lit(1.0)), 6)).where(F.col("score") > least).drop("named")


def rendered_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths with the relation between each two nodes: `a -calls-> b`; the first relation by name where there are several."""
    label = edges.groupBy("source", "target").agg(F.min("relation_type").alias("relation"))
    hop = paths.withColumn("n", F.xxhash64("source", "target", "path")).select("n", "path", F.posexplode("path").alias("at", "node"))
    hop = hop.where(F.col("at") < F.size("path") - 1).withColumn("next", F.get("path", F.col("at") + 1))
    hop = hop.join(label, (hop.node == label.source) & (hop.next == label.target), "left")
    parts = F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit(" -"), F.coalesce("relation", F.lit("?")), F.lit("-> "), "next").alias("t"))))
    return hop.groupBy("n", "path").agg(F.concat(F.element_at("path", 1), F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("text")).drop("n")


def direct_import_edges(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Edges of resolved imports(path, language, name, target): `references` for Markdown, else `imports` (0.95); and back where an export name of the target is part of the import text (0.9)."""
    forth = imports.select(F.col("path").alias("source"), "target", F.when(F.col("language") == "markdown", "references").otherwise("imports").alias("relation_type"), F.lit(0.95).alias("confidence"), F.lit(1.0).alias("weight"))
    used = imports.join(exports.select(F.col("path").alias("target"), F.col("name").alias("export")), "target").where(F.contains("name", "export"))
    back = used.select(F.col("target").alias("source"), F.col("path").alias("target"), F.lit("exports").alias("relation_type"), F.lit(0.9).alias("confidence"), F.lit(0.8).alias("weight")).distinct()
    return forth.unionByName(back)


def consumers(changed: list[str], edges: DataFrame, files: int = 5, each: int = 5) -> DataFrame:
    """Who depends on the first changed files: up to `each` sources a file."""
    from tessera.functions.rows import top

    return top(edges.where(F.col("target").isin(changed[:files])).select("target", "source").distinct(), ["target"], [F.col("source")], each)


def search_composition(lexical: DataFrame, semantic: DataFrame, cap: int = 50) -> DataFrame:
    """Lexical hits first, then semantic ones that aren't among them."""
    rows = lexical.select("id", F.lit(0).alias("origin"), "rank").unionByName(semantic.join(lexical, "id", "left_anti").select("id", F.lit(1).alias("origin"), "rank"))
    return rows.orderBy("origin", "rank", "id").limit(cap)


def purge(store: Store, paths: DataFrame) -> None:
    nodes, edges = graph.purge(store.read("graph_nodes"), store.read("graph_edges"), paths)
    store.replace("graph_edges", edges)
    store.replace("graph_nodes", nodes)
