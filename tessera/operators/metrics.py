"""Retrieval metrics over lists (query_id, id, rank from 0) and graded truths (query_id, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rows import computed, tokens, top


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc_id of documents whose text holds the passage. Candidates share the passage's rarest inner word, so no pair is built for nothing."""
    words = computed(docs.select("doc_id", "text"), words=F.array_distinct(tokens("text"))).select("doc_id", F.explode("words").alias("term"))
    # the first and the last word of a passage may be parts of longer words in a document
    inner = F.array_distinct(F.slice(tokens("passage"), 2, F.greatest(F.size(tokens("passage")) - 2, F.lit(0))))
    asked = computed(passages, words=inner).select("query_id", F.explode("words").alias("term"))
    df = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = top(asked.join(df, "term"), ["query_id"], [F.col("df"), F.col("term")], 1).select("query_id", "term")
    pairs = words.join(rare, "term").select("query_id", "doc_id")
    whole = docs.select("doc_id", "text").join(pairs, "doc_id").join(passages, "query_id")
    few = passages.where(F.size(tokens("passage")) < 3)
    short = docs.select("doc_id", "text").join(few, F.contains("text", "passage"))
    return whole.where(F.contains("text", "passage")).select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id")).distinct()


def _rounded(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 6)


def per_query(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Hit, MRR, NDCG (linear gain) and recall of every query that has a truth. Each truth looks up its place, so queries without a hit stay."""
    rows = truth.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id")))
    rows = rows.join(hits.select("query_id", "id", (F.col("rank") + 1).alias("place")), ["query_id", "id"], "left")
    gain = lambda at: F.sum(F.when(F.col(at) <= 10, F.col("grade") / F.log2(F.col(at) + 1)))
    within = lambda k: F.count_if(F.col("place") <= k)
    own = rows.groupBy("query_id").agg(F.count("*").alias("n_truth"), gain("n").alias("ideal"), gain("place").alias("dcg"), (1 / F.min("place")).alias("rr"), within(5).alias("r5"), within(10).alias("r10"))
    hit = lambda c: (F.col(c) > 0).cast("double")
    return own.select(
        "query_id", hit("r5").alias("hit_at_5"), hit("r10").alias("hit_at_10"), _rounded(F.col("rr")).alias("mrr"),
        _rounded(F.col("dcg") / F.col("ideal")).alias("ndcg_at_10"), _rounded(F.col("r5") / F.col("n_truth")).alias("recall_at_5"), _rounded(F.col("r10") / F.col("n_truth")).alias("recall_at_10"),
    )


def per_file(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """hits (query_id, file, rank) collapsed to the first of each file; acc: all files found."""
    first = hits.groupBy("query_id", "file").agg(F.min("rank").alias("rank"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    own = truth.distinct().join(first, ["query_id", "file"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.count_if(F.col("place") <= 5).alias("in5"), F.count_if(F.col("place") <= 10).alias("in10"), F.count("place").alias("found"))
    hit = lambda k: F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return own.select("query_id", hit(1), hit(5), hit(10), (F.col("in5") == F.col("n")).alias("acc_at_5"), (F.col("in10") == F.col("n")).alias("acc_at_10"), _rounded(F.col("found") / F.col("n")).alias("recall"), _rounded(1 / F.col("first")).alias("mrr"))


def range_grades(results: DataFrame, truths: DataFrame) -> DataFrame:
    """Best grade of each result(query_id, rank, path, start, end) among overlapping truths(query_id, path, t_start, t_end, grade), 0 if none."""
    hit = (F.col("t_start") <= F.col("end")) & (F.col("start") <= F.col("t_end"))
    best = results.join(truths, ["query_id", "path"]).where(hit).groupBy("query_id", "rank").agg(F.max("grade").alias("grade"))
    return results.join(best, ["query_id", "rank"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def parse_truths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot `path:start-end:grade` columns; cells of another form are left out."""
    cells = df.select("query", F.explode(F.array(*columns)).alias("cell"))
    part = lambda k: F.regexp_extract("cell", r"^(.*):(\d+)-(\d+):(\d+(?:\.\d+)?)$", k)
    return cells.select("query", part(1).alias("path"), part(2).cast("int").alias("t_start"), part(3).cast("int").alias("t_end"), part(4).cast("double").alias("grade")).where(F.col("path") != "")


def gate(per: DataFrame, least_hit_at_5: float = 0.70) -> tuple[dict[str, float], bool]:
    """Means of all metrics and whether Hit@5 reaches the gate."""
    names = [c for c in per.columns if c != "query_id"]
    row = per.agg(*[F.avg(c).alias(c) for c in names]).first()
    means = {c: float(row[c] or 0.0) for c in names}
    return means, means.get("hit_at_5", 0.0) >= least_hit_at_5
