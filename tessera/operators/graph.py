"""Property graph operators over nodes(id, ..) and edges(source, target, relation_type, ..)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.rows import top

#: Words that a lexical node search leaves out.
STOP_WORDS = "a an and are by calls does for from how in is of or the to uses what where who".split()


def checkpoint_dir(spark: SparkSession) -> None:
    """Iterations cut their lineage with checkpoint() in the folder of spark.checkpoint.dir. Where it is unset, a new
    local folder serves a local master; any other master raises, since its executors wouldn't see it."""
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="tessera-"))


def written(df: DataFrame) -> DataFrame:
    """df as files in the checkpoint folder: unlike an aggregate or a checkpoint, a plain scan gives a join two shuffles
    that adaptive execution can split."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def edge_dedup(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, relation_type): highest confidence, then weight, then description."""
    return top(edges, ["source", "target", "relation_type"], [F.col("confidence").desc(), F.col("weight").desc(), F.col("description")], 1)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def enrichment_merge(live: DataFrame, stored: DataFrame, live_edges: DataFrame, stored_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored descriptions (non-empty) win; stored file nodes that are missing come in; of stored edges those without `::` whose ends exist."""
    said = stored.select("id", F.nullif("description", F.lit("")).alias("said"))
    nodes = live.join(said, "id", "left").withColumn("description", F.coalesce("said", "description")).select(*live.columns)
    nodes = nodes.unionByName(stored.where("kind = 'file'").join(live, "id", "left_anti").select(*live.columns))
    files = stored_edges.where(~F.contains("source", F.lit("::")) & ~F.contains("target", F.lit("::")))
    return nodes, live_edges.unionByName(without_dangling(files, nodes))


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """id, neighbour, relation_type, direction for seeds(id)."""
    edges = edges if relation is None else edges.where(F.col("relation_type") == relation)
    parts = {"outgoing": ("source", "target"), "incoming": ("target", "source")}
    out = None
    for name, (a, b) in parts.items():
        if direction in (name, "both"):
            part = edges.join(seeds.select(F.col("id").alias(a)), a, "left_semi").select(F.col(a).alias("id"), F.col(b).alias("neighbour"), "relation_type", F.lit(name).alias("direction"))
            out = part if out is None else out.unionByName(part)
    return out


def reach(edges: DataFrame, start: DataFrame, max_depth: int, relation: str | None = None) -> DataFrame:
    """start, id, depth (least) of all nodes within max_depth edges, start(id) included. One join and one anti-join a level."""
    checkpoint_dir(edges.sparkSession)
    edges = (edges if relation is None else edges.where(F.col("relation_type") == relation)).select("source", "target").distinct()
    seen = front = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        step = front.join(edges, front.id == edges.source).select("start", F.col("target").alias("id")).distinct()
        front = step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, start: DataFrame, end: DataFrame, max_depth: int, cap: int | None = config.MAX_PATHS) -> DataFrame:
    """source, target, length, path: simple paths of at most max_depth edges, never extended at their end.

    cap: paths kept per pair, shortest first, ties by node names (the live variant); None: all.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.select("source", "target").distinct()
    ends = end.select(F.col("id").alias("target")).distinct()
    front = start.select("id", F.array("id").alias("path"))
    found = None
    for length in range(1, max_depth + 1):
        step = front.join(edges, front.id == edges.source).where(~F.array_contains("path", F.col("target")))
        step = step.select(F.col("target").alias("id"), F.array_append("path", F.col("target")).alias("path")).checkpoint()
        done = step.join(ends.withColumnRenamed("target", "id"), "id", "left_semi")
        hit = done.select(F.element_at("path", 1).alias("source"), F.col("id").alias("target"), F.lit(length).alias("length"), "path")
        found = hit if found is None else found.unionByName(hit)
        front = step.join(ends.withColumnRenamed("target", "id"), "id", "left_anti")
    return found if cap is None else top(found, ["source", "target"], [F.col("length"), F.col("path")], cap)


def weak_components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (least id that is connected in either direction). Large-star and small-star steps until nothing changes."""
    checkpoint_dir(edges.sparkSession)
    cur = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # a hub's edges can be split then
        cur = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        least = written(cur.groupBy("u").agg(F.min("v").alias("m")))
        cur = cur.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        cur = cur.where("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    root = cur.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select("id").distinct().join(root.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def needs_indexing(nodes: DataFrame | None, edges: DataFrame | None) -> bool:
    """A graph table is missing or empty."""
    return nodes is None or edges is None or nodes.isEmpty() or edges.isEmpty()


def page_of(nodes: DataFrame, offset: int, limit: int, order: str = "id") -> DataFrame:
    """One page of a table in the order of a unique column."""
    return nodes.orderBy(order).offset(offset).limit(limit)


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section (node or edge), name, n; name null: the total."""
    part = lambda df, col, section: df.rollup(col).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.col(col).alias("name"), "n")
    return part(nodes, "kind", "node").unionByName(part(edges, "relation_type", "edge"))


def search_nodes(nodes: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Lexical search of terms(query_id, term) over nodes(id, name, aliases, path): a term scores its first tier.

    Tiers: 100 exact name, 40 prefix, 20 inside the name, 30 exact alias, 10 inside an alias, 5 id or path.
    """
    asked = terms.where(~F.col("term").isin(STOP_WORDS) & (F.col("term") != "")).distinct()
    low = nodes.select("id", F.lower("name").alias("n"), F.transform("aliases", lambda a: F.lower(a)).alias("al"), F.lower(F.concat_ws(" ", "id", "path")).alias("p"))
    t = F.col("term")
    tier = F.when(F.col("n") == t, 100).when(F.startswith("n", t), 40).when(F.contains("n", t), 20).when(F.array_contains("al", t), 30)
    tier = tier.when(F.exists("al", lambda a: F.contains(a, t)), 10).when(F.contains("p", t), 5)
    hits = low.join(F.broadcast(asked), tier.isNotNull()).groupBy("query_id", "id").agg(F.sum(tier).alias("score"))  # a request has at most 10 queries of 500 bytes
    return top(hits, ["query_id"], [F.col("score").desc(), F.length("id"), F.col("id")], limit, "rank")


def node_filter(hits: DataFrame, nodes: DataFrame, text: str, least: float, limit: int, by: str = "query_id") -> DataFrame:
    """Nearest nodes that are similar enough or hold the text in name, kind, description or a symbol; text hits first, then similarity."""
    rows = hits.join(nodes, "id")
    has = F.contains(F.lower(F.concat_ws("\n", "name", "kind", "description", F.array_join("symbols", "\n"))), F.lit(text.lower()))
    rows = rows.withColumn("text_hit", has).where(has | (1 - F.col("distance") > least))
    return top(rows, [by], [F.col("text_hit").desc(), F.col("distance"), F.col("id")], limit, "place").select(by, "id", "distance", "text_hit", "place")


def boosted(similarity: Column, direct: Column, described: Column, least: float) -> tuple[Column, Column]:
    """In-memory variant: a hit in name, kind or symbols lifts the similarity to 0.9; a hit in the description only lets the node in. (score, keep)."""
    return F.when(direct, F.greatest(similarity, F.lit(0.9))).otherwise(similarity), direct | described | (similarity > least)


def neighbour_scores(edges: DataFrame, seeds: DataFrame, by: str = "query_id") -> DataFrame:
    """by, id, score: for seeds(by, id), the sum of weight * confidence over edges to files that aren't seeds."""
    parts = []
    for a, b in (("source", "target"), ("target", "source")):
        parts.append(edges.join(seeds.withColumnRenamed("id", a), a).select(by, F.col(b).alias("id"), (F.col("weight") * F.col("confidence")).alias("w")))
    return parts[0].unionByName(parts[1]).join(seeds, [by, "id"], "left_anti").groupBy(by, "id").agg(F.round(F.sum("w"), 6).alias("score"))


def expand(hits: DataFrame, blocks: DataFrame, edges: DataFrame, by: str = "query_id", max_add: int = 24) -> DataFrame:
    """Blocks of the best neighbour files of the first hits: hits(by, hash, path, rank), blocks(path, hash, start_line).

    The first SEEDS hits are seeds; EXPAND_FILES files, EXPAND_BLOCKS blocks a file, none that is a hit already.
    """
    seeds = hits.where(F.col("rank") < config.SEEDS).select(by, F.col("path").alias("id")).distinct()
    files = top(neighbour_scores(edges, seeds, by), [by], [F.col("score").desc(), F.col("id")], config.EXPAND_FILES, "file_rank")
    first = top(blocks.join(files.select(F.col("id").alias("path")).distinct(), "path", "left_semi"), ["path"], [F.col("start_line"), F.col("hash")], config.EXPAND_BLOCKS, "block_rank")
    new = files.withColumnRenamed("id", "path").join(first, "path").join(hits.select(by, "hash"), [by, "hash"], "left_anti")
    new = top(new, [by, "hash"], [F.col("file_rank"), F.col("block_rank")], 1)
    return top(new, [by], [F.col("file_rank"), F.col("block_rank")], max_add, "added").select(by, "hash", "path", "score", "added")


def task_subgraph(hits: DataFrame, edges: DataFrame, budget: int, by: str = "query_id", extra: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes (by, id, core) and edges (by, source, target) for the best nodes and up to `extra` one-hop neighbours.

    A node counts 100 tokens and an edge between core nodes 50; neighbours come in while the budget holds.
    """
    core = hits.select(by, "id").distinct()
    induced = edges.select("source", "target").distinct().join(core.withColumnRenamed("id", "source"), "source").join(core.withColumnRenamed("id", "target"), [by, "target"]).select(by, "source", "target")
    parts = [edges.select("source", "target").join(core.withColumnRenamed("id", a), a).select(by, F.col(b).alias("id")) for a, b in (("source", "target"), ("target", "source"))]
    near = top(parts[0].unionByName(parts[1]).distinct().join(core, [by, "id"], "left_anti"), [by], [F.col("id")], extra, "n")
    used = core.groupBy(by).agg((100 * F.count("*")).alias("nodes")).join(induced.groupBy(by).agg((50 * F.count("*")).alias("own")), by, "left").select(by, (F.col("nodes") + F.coalesce("own", F.lit(0))).alias("used"))
    near = near.join(used, by).where(F.col("used") + 100 * (F.col("n") + 1) <= budget).select(by, "id", F.lit(False).alias("core"))
    return core.select(by, "id", F.lit(True).alias("core")).unionByName(near), induced


def purge(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the nodes of paths(path) and all their edges."""
    gone = nodes.join(paths, "path", "left_semi").select("id").distinct()
    return nodes.join(gone, "id", "left_anti"), edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)


def merge_overlay(main: tuple[DataFrame, DataFrame], branch: tuple[DataFrame, DataFrame], overridden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main graph without overridden paths, then the branch graph; on equal ids the branch wins, edges are appended, dangling ones go."""
    nodes, edges = purge(*main, overridden)
    nodes = nodes.join(branch[0].select("id"), "id", "left_anti").unionByName(branch[0])
    return nodes, without_dangling(edges.unionByName(branch[1]), nodes)


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "relation_type").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def worth_describing(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.size("exports") >= 2) | (F.col("size_lines") >= 50) | (F.size("symbols") >= 3))


def contains_edges(symbols: DataFrame) -> DataFrame:
    """File to symbol edges of symbols(path, id)."""
    return symbols.select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation_type"), F.lit("").alias("description"), F.lit(1.0).alias("confidence"), F.lit(0.3).alias("weight"), F.lit("extracted").alias("provenance"))


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """symbols(path, owner, name, start_line) with id: path::owner::name, and @line where a file has it twice."""
    n = F.count("*").over(Window.partitionBy("path", "owner", "name"))
    return symbols.withColumn("id", F.concat(F.concat_ws("::", "path", "owner", "name"), F.when(n > 1, F.concat(F.lit("@"), F.col("start_line") + 1)).otherwise("")))


def parent_child(paths_: DataFrame) -> DataFrame:
    """parent, child of paths that differ by one component."""
    child = paths_.select(F.col("path").alias("child"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("path")).where("path <> ''")
    return child.join(paths_, "path", "left_semi").select(F.col("path").alias("parent"), "child")


def resolve_id(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(text) to node ids, first tier that has one: exact, normalised, caseless or suffix (shortest), unique `::suffix`, unique bare symbol."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")
    n = nodes.select("id", norm(F.col("id")).alias("norm"), F.lower("id").alias("low"), F.element_at(F.split("id", "::"), -1).alias("bare")).withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("low", "/"))), lambda k: F.array_join(F.slice(F.split("low", "/"), -k, k), "/"))))
    sym = nodes.where(F.contains("id", F.lit("::"))).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("id", "::")) - 1), lambda k: F.array_join(F.slice(F.split("id", "::"), -k, k), "::"))).alias("suffix"))
    sym = sym.groupBy("suffix").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    whole = n.dropDuplicates(["id"])
    tiers = [
        asked.join(whole, F.col("text") == F.col("id")).select("text", "id", F.lit(0).alias("tier")),
        asked.join(whole, norm(F.col("text")) == F.col("norm")).select("text", "id", F.lit(1).alias("tier")),
        asked.join(n, F.lower("text") == F.col("tail")).select("text", "id", F.lit(2).alias("tier")),
        asked.join(sym, F.col("text") == F.col("suffix")).select("text", "id", F.when(F.contains("suffix", F.lit("::")), 3).otherwise(4).alias("tier")),
    ]
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return top(out, ["text"], [F.col("tier"), F.length("id"), F.col("id")], 1)
