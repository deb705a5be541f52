"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Memtables: each input partition of a batch is one memtable. It is flushed as a run: (digest, doc_id) sorted by
digest. A batch's runs are combined by digest (before the shuffle, so a copy held by a third of all rows is one row
a task) into a level: (digest, keep_id, group_size), range-partitioned and sorted by digest, with a bitmap filter of
its digests beside it.
Lookup: a new level's digests go through the filter of each older level; only those that pass meet that level's
entries in a join. What is found there, and what a level holds more than once, are hits.
Compaction: where FANOUT levels lie, they are merged in the order of their digests: ranges of the same bounds meet
in one task, sorted, and the smallest identifier and the sum of the sizes of each digest stay. A digest has at most
one entry a level, so no range is hot.
Verification: the hits' filter picks the rows that may be hits; their normalised bytes are compared through the
least and the greatest text of each digest (combined before the shuffle). Digests whose bytes differ are split by
text, so a digest collision can't merge two texts.

Defined cases: a null text counts as empty, empty texts are equal to each other. Repeated rows (same doc_id and
text) count in group_size and get the same decision. A null doc_id never wins against a value; where all ids of
a group are null, keep_id is null and the rows are kept. doc_id may have any ordered type. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, stored

#: Levels that are merged into one.
FANOUT = 4
#: The bitmap filter has 16 bits a digest, up to this many bits (8 MB). Beyond, it lets more rows through to the exact join or comparison.
FILTER_BITS = 1 << 26


def normalised(text: str | Column = "text") -> Column:
    """Each run of white space becomes one space. Runs that are one space already need no work."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), rf"[\x09-\x0D][{SPACES}]*|\x20[{SPACES}]+", " ")


def digest(text: Column, key_bytes: int) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, key_bytes)


def flush_runs(docs: DataFrame, key_bytes: int = 32) -> DataFrame:
    """(digest, sha, doc_id), one sorted run per input partition."""
    text = normalised()
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha")).select(F.substring("sha", 1, key_bytes).alias("digest"), *(["sha"] if key_bytes < 32 else []), "doc_id")
    return stored(rows.sortWithinPartitions("digest", "doc_id"), "dedup-runs", compression="zstd")


def _bits(n: int) -> int:
    return min(FILTER_BITS, max(1 << 15, 1 << (16 * n - 1).bit_length()))


def _at(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def build_filter(digests: DataFrame, bits: int) -> DataFrame:
    """The bitmap filter of digests: bucket, bitmap. At most FILTER_BITS / 8 bytes."""
    at = digests.select(_at(bits).alias("at"))
    return stored(at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")), "dedup-filter")


def may_hit(rows: DataFrame, filt: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest is in the filter: all true hits and some others."""
    bit = F.expr("shiftright(cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(at) % 8 as int)) & 1")
    # at most FILTER_BITS / 8 bytes are broadcast, whatever the input
    return rows.withColumn("at", _at(bits)).withColumn("bucket", F.bitmap_bucket_number("at")).join(F.broadcast(filt), "bucket").where(bit == 1).drop("at", "bucket", "bitmap")


@dataclass
class Level:
    """entries: (digest, keep_id, group_size), one row a digest, sorted; filter: build_filter() of their digests."""

    entries: DataFrame
    filter: DataFrame
    bits: int


def _sealed(entries: DataFrame) -> Level:
    """Entries (one a digest) as a level: ranges of digests, each sorted, and their filter."""
    ordered = stored(entries.repartitionByRange("digest").sortWithinPartitions("digest"), "dedup-level", compression="zstd")
    bits = _bits(ordered.count())
    return Level(ordered, build_filter(ordered, bits), bits)


def merged(levels: list[Level]) -> DataFrame:
    """Compaction: entries of the levels by ranges of digests, each range sorted; its sort serves the aggregate, so nothing is shuffled twice."""
    entries = reduce(DataFrame.union, (x.entries for x in levels)).repartitionByRange("digest").sortWithinPartitions("digest")
    return entries.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


@dataclass
class Index:
    """A log-structured merge index of digests. key_bytes: length of the key; shorter keys (tests) collide, the results stay the same."""

    key_bytes: int = 32
    levels: list[Level] = field(default_factory=list)
    runs: list[DataFrame] = field(default_factory=list)
    docs: list[DataFrame] = field(default_factory=list)
    hits: list[DataFrame] = field(default_factory=list)

    def add(self, docs: DataFrame) -> None:
        """Flush a batch, look it up in the older levels, and compact where there are FANOUT levels."""
        docs = docs.select("doc_id", "text")
        runs = flush_runs(docs, self.key_bytes)
        new = _sealed(runs.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        self.hits.append(new.entries.where("group_size > 1").select("digest"))
        for old in self.levels:
            passed = may_hit(new.entries.select("digest"), old.filter, old.bits)
            self.hits.append(stored(passed.join(old.entries.select("digest"), "digest"), "dedup-hits", compression="zstd"))
        self.levels.append(new)
        self.runs.append(runs)
        self.docs.append(docs)
        if len(self.levels) >= FANOUT:
            self.levels = [_sealed(merged(self.levels))]

    def decisions(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every row of all batches."""
        runs, docs = reduce(DataFrame.union, self.runs), reduce(DataFrame.union, self.docs)
        level = self.levels[0].entries if len(self.levels) == 1 else stored(merged(self.levels), "dedup-merged", compression="zstd")
        hits = reduce(DataFrame.union, self.hits).distinct() if len(self.hits) > 1 else self.hits[0]
        n_hits = hits.count()
        sha = F.col("sha") if self.key_bytes < 32 else F.col("digest")
        if n_hits:
            rows = docs.select("doc_id", normalised().alias("text")).withColumn("digest", digest(F.col("text"), self.key_bytes))
            bits = _bits(n_hits)
            bytes_of = may_hit(rows, build_filter(hits, bits), bits).groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
            split = stored(bytes_of.where("lo <> hi").select("digest"), "dedup-split")
            if not split.isEmpty():
                by_text = stored(rows.join(split, "digest", "left_semi").groupBy("digest", F.unhex(F.sha2("text", 256)).alias("sha"), "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("text"), "dedup-by-text")
                whole = runs.join(split, "digest", "left_anti").join(level, "digest")
                parts = runs.withColumn("sha", sha).join(by_text, ["digest", "sha"])
                return _result(whole, sha).union(_result(parts, F.col("sha")))
        return _result(runs.join(level, "digest"), sha)


def exact_dedup(docs: DataFrame, key_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs: one batch on an empty index."""
    index = Index(key_bytes)
    index.add(docs)
    return index.decisions()


def _result(rows: DataFrame, sha: Column) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
