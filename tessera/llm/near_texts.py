"""Near copies of texts: MinHash bands propose, exact Jaccard over 5-word shingles decides.

Shingles: WORDS words in a row (ASCII lower case, ASCII white space splits, as in op7_simhash), as XXH64 values; a
shorter text is one shingle. Two texts are linked where the Jaccard similarity of their shingle sets is at least
SIMILARITY. Texts are told apart by their own 64-bit hash.

Candidates share one of BANDS bands of ROWS MinHash values. A pair at 0.8 shares none with a probability of
(1 - 0.8^5)^40 = 1.2e-7, more similar pairs with less; that is the only loss. Anchor covering of fingerprints can't
serve here: such pairs lie up to 11 bits apart.

In each bucket all pairs count, but not all are written: STARS rounds compare one member with the others and join
what is linked, then members that are still apart are compared by odd sketches inside a task, and only pairs that
these can't rule out leave it. An odd sketch has a bit for each of n hash values, which is set if an odd number of
shingles have it. Two sketches differ in at most as many bits as the sets differ in shingles, and sets of a and b
shingles with similarity s differ in at most (a + b)(1 - s) / (1 + s): no link is lost. n grows with the text, so
that long texts are told apart as well. A bucket over SPLIT members or BYTES of sketches is dealt to parts and each
pair of parts is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, stored, tasks

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, STARS = 40, 5, 1
#: Shingles that one vectorised step handles, pairs that leave in one batch, words of sketches that one step compares.
STEP, PAIRS, COMPARED = 1024, 1 << 16, 1 << 20
#: Bits of the smallest odd sketch; members and bytes of sketches of a bucket that one task compares.
BITS, SPLIT, BYTES = 1024, 1 << 13, 1 << 22
_odd, _add = np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * ROWS, 1)).astype(np.uint32)
_odd |= np.uint32(1)
_mix = np.random.default_rng(SEED + 1).integers(0, 2**63, (BANDS, ROWS + 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole, ends = b" ".join(ws), np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    h, starts = xxhash.xxh64_intdigest, np.concatenate(([0], ends[:-words] + 1)).tolist()
    return np.unique(np.array([h(whole[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def buckets(values: np.ndarray) -> np.ndarray:
    """One signed long for each band: a mix of its MinHash values, which are minima of 32-bit linear permutations."""
    least, x = np.full(BANDS * ROWS, 2**32 - 1, np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), STEP):
        np.minimum(least, (x[at : at + STEP] * _odd + _add).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * _mix[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _mix[:, ROWS]
    return (mixed ^ mixed >> np.uint64(31)).view(np.int64)


def key() -> Column:
    """What tells texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(values: np.ndarray) -> bytes:
    """The odd sketch of a set of shingles: BITS bits, doubled until there are as many as shingles."""
    n = BITS
    while n < len(values):
        n *= 2
    odd = np.bincount((values & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each whole cell, from rows sorted by cell."""
    held: list[list[np.ndarray]] = []

    def whole(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        cut = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        for at, to in zip(cut.tolist(), [*cut[1:].tolist(), len(cols[0])], strict=True):
            yield [c[at:to] for c in cols]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held[0][0][0] == held[-1][0][-1]:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        to = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        yield from whole([c[:to] for c in cols])
        held = [[c[to:] for c in cols]]
    if held:
        yield from whole([np.concatenate(x) for x in zip(*held, strict=True)])


def close(key: np.ndarray, label: np.ndarray, size: np.ndarray, side: np.ndarray, of: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys (lesser first) with different labels whose sketches allow the similarity. side: 1 members meet
    2 members, 3 is both. The sizes of such sets differ little, so their sketches are of one length or the next
    one's halves are folded."""
    if (label == label[0]).all():
        return
    width = np.fromiter(map(len, of), np.int64, len(of))
    most = (1 - similarity) / (1 + similarity)
    lengths = 2 + int(-np.log2(similarity))  # sizes differ by 1 / similarity at most
    for w in np.unique(width).tolist():
        here = np.flatnonzero(width == w)
        own = np.frombuffer(b"".join(of[here].tolist()), np.uint64).reshape(len(here), -1)
        for times in range(lengths):
            up = np.flatnonzero(width == w << times)
            if not len(up):
                continue
            other = np.bitwise_xor.reduce(np.frombuffer(b"".join(of[up].tolist()), np.uint64).reshape(len(up), 1 << times, -1), axis=1)
            step = max(1, COMPARED // (len(up) * own.shape[1]))
            for at in range(0, len(here), step):
                i = here[at : at + step, None]
                apart = np.bitwise_count(own[at : at + step, None] ^ other).sum(axis=2, dtype=np.int64)
                ok = (apart <= most * (size[i] + size[up]) + 1e-6) & (label[i] != label[up])
                ok &= ((side[i] & 1) & (side[up] >> 1) | (side[i] >> 1) & (side[up] & 1)) == 1
                if not times:
                    ok &= key[i] < key[up]
                x, y = np.nonzero(ok)
                if len(x):
                    x, y = key[here[at + x]], key[up[y]]
                    yield np.minimum(x, y), np.maximum(x, y)


def _candidates(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, *cols in _cells(batches):
            for p in close(*cols, similarity):
                held.append(p)
                n += len(p[0])
                if n >= PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b"])

    return run


def _stars(now: DataFrame, star: int) -> DataFrame:
    """Pairs of one member of each bucket and those that are apart from it."""
    centre = stored(now.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("_key", F.lit(star)).alias("by"), "_key", "label")).alias("hub")), "near-centres", compression="zstd")
    # both sides are plain scans, so adaptive execution can split a bucket
    far = now.join(centre, "bucket").where("label <> hub.label")
    return far.select(F.least("_key", "hub._key").alias("a"), F.greatest("_key", "hub._key").alias("b"))


def _apart(now: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Pairs of all members of each bucket that are apart and that their sketches don't rule out."""
    now = stored(now.join(own.select("_key", F.octet_length("sketch").alias("bytes")), "_key"), "near-labels", compression="zstd")
    large = F.greatest(F.ceil(F.count("*") / SPLIT), F.ceil(F.sum("bytes") / BYTES)).cast("int")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), large.alias("parts"))
    mixed = stored(mixed.where("lo <> hi").select("bucket", "parts"), "near-mixed", compression="zstd")
    rows = now.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("_key", F.lit(BANDS)), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") < F.col("with"), 1).when(F.col("part") > F.col("with"), 2).otherwise(3).cast("long")
    cell = F.xxhash64("bucket", F.least("part", "with"), F.greatest("part", "with"))
    rows = rows.select(cell.alias("cell"), "_key", "label", side.alias("side"))
    rows = rows.join(own.select("_key", F.size("shingles").cast("long").alias("size"), "sketch"), "_key").select("cell", "_key", "label", "size", "side", "sketch")
    return rows.repartition(tasks(now.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(_candidates(similarity), "a long, b long")


def linked(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """_key, root of every text that has a near copy: root is the least key of its component."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                of = np.concatenate([buckets(shingles(t.as_py(), words)) for t in b.column(1)] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(of), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], ["bucket", "_key"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                of = [shingles(t.as_py(), words) for t in part.column(1)]
                cols = [part.column(0), pa.array([x.view(np.int64) for x in of], pa.list_(pa.int64())), pa.array([sketch(x) for x in of], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "shingles", "sketch"])

    texts = docs.select(key().alias("_key"), "text")
    rows = stored(texts.mapInArrow(bands, "bucket long, _key long"), "near-bands")
    # copies count once: partial aggregates and plain scans, so that no bucket needs one task
    shared = rows.groupBy("bucket").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).where("lo <> hi")
    shared = stored(shared.select("bucket"), "near-shared", compression="zstd")
    members = stored(rows.join(shared, "bucket", "left_semi").distinct(), "near-members", compression="zstd")
    wanted = stored(members.select("_key").distinct(), "near-wanted")
    own = texts.join(wanted, "_key", "left_semi").mapInArrow(sets, "_key long, shingles array<long>, sketch binary")
    own = stored(own.dropDuplicates(["_key"]), "near-shingles")
    a, b = (own.select(F.col("_key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    edges, comp = None, None
    for star in (*range(STARS), None):
        label = F.col("_key") if comp is None else F.coalesce("root", "_key")
        now = (members if comp is None else members.join(comp, "_key", "left")).select("bucket", "_key", label.alias("label"))
        pairs = _apart(now, own, similarity) if star is None else _stars(now, star)
        pairs = stored(pairs.distinct(), "near-pairs")
        near = pairs.join(a, "a").join(b, "b").withColumn("n", both).where(F.col("n") / (F.size("sa") + F.size("sb") - F.col("n")) >= similarity)
        found = stored(near.select(F.col("a").alias("u"), F.col("b").alias("v")), "near-edges")
        edges = found if edges is None else edges.unionByName(found)
        comp = stored(components(edges).withColumnRenamed("u", "_key"), "near-components")
    return comp
