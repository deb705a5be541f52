"""SimHash near-dedup by anchor-point covering.

Fingerprints: 64 bits, a majority vote over the XXH64 values of 3-word shingles.

Anchors: the 64 bits are cut into blocks and each block gets a perfect covering code: two binary Golay codes of
length 23 (radius 3), three repetition codes of length 5 (radius 2) and one of length 3 (radius 1). Their direct
sum has 2^28 code words, the anchors. A perfect code has exactly one code word within its radius, so every
fingerprint has one home anchor. A fingerprint q within THRESHOLD bits of p differs from p by e_b bits in block
b with sum(e_b) <= THRESHOLD, hence lies within radius_b + e_b of p's home in every block. Each distinct
fingerprint is therefore replicated to all anchors at most radius_b + e_b away in block b for some such e (about
90 anchors, whatever the input), and in each anchor the fingerprints at home are compared with all that came.
No link is lost and no cap exists.

Comparison streams the rows of a partition, sorted by anchor, in numpy; from each anchor only a spanning forest
of its links leaves, never all pairs. An anchor with many members is compared in blocks, or by probing all
2,080 neighbours of each home fingerprint where that is less work. An anchor with more than SPLIT members isn't
held in one task: its home fingerprints are dealt to parts, its members are dealt to parts as well, and each pair
of parts is compared in a task of its own.

near_dedup(similarity=...) also links texts with that Jaccard similarity of 5-word shingles or more. Such pairs lie
up to 11 bits apart, where covering would need more anchors than there are fingerprints, so near_texts proposes
them by MinHash bands. The contract's query takes two bits alone; the pipeline's stage takes both.

Defined cases: null and white-space-only texts have fingerprint zero and link like others. Repeated rows share a
component. component_id ignores null doc_ids. doc_id keeps its type (integers or texts). Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near_texts
from tessera.llm.common import components, stored, tasks

WORDS, SEED, THRESHOLD = 3, 42, 2
#: Blocks of the covering code: (length, radius, generator polynomial; 0: repetition code).
BLOCKS = ((23, 3, 0xC75), (23, 3, 0xC75), (5, 2, 0), (5, 2, 0), (5, 2, 0), (3, 1, 0))
#: Rows that one vectorised step handles.
STEP = 1 << 16
#: Members of one anchor that a task holds (17 bytes each).
SPLIT = 1 << 21


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    k = min(WORDS, len(words))
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, votes, h = len(words) - k + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        a, b = starts[at : min(n, at + STEP)].tolist(), ends[at + k - 1 : min(n, at + STEP) + k - 1].tolist()
        values = np.fromiter([h(whole[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64, len(a))
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def code() -> list[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For each block: shift, mask, two syndrome tables, and by excess e = 0, 1, 2 the error patterns of weight radius + e (0: at most the radius) of each syndrome, already shifted, with their validity."""
    out, shift, known = [], 0, {}
    for n, radius, poly in BLOCKS:
        if (n, poly) not in known:
            x = np.arange(1 << n, dtype=np.int64)
            s = x.copy()
            if poly:
                top = poly.bit_length() - 1
                for i in range(n - 1, top - 1, -1):
                    s ^= np.where(s >> i & 1, poly << (i - top), 0)
            else:
                s = np.where(x & 1, x ^ ((1 << n) - 1), x) >> 1
            weight = np.bitwise_count(x.astype(np.uint64)).astype(np.int64)
            groups = []
            for e in range(THRESHOLD + 1):
                pick = x[weight <= radius] if e == 0 else x[weight == radius + e]
                pick = pick[np.argsort(s[pick], kind="stable")]
                size = np.bincount(s[pick], minlength=int(s.max()) + 1)
                rank = np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
                pats, ok = np.zeros((len(size), max(1, size.max())), np.uint64), np.zeros((len(size), max(1, size.max())), bool)
                pats[s[pick], rank], ok[s[pick], rank] = pick.astype(np.uint64), True
                groups.append((pats, ok))
            assert groups[0][1].sum() == len(groups[0][0]), "the code isn't perfect"
            known[n, poly] = s, groups
        s, groups = known[n, poly]
        out.append((shift, (1 << n) - 1, s, [p << np.uint64(shift) for p, _ in groups], [ok for _, ok in groups]))
        shift += n
    assert shift == 64
    return out


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, index into fps, at home?: every anchor within covering radius plus threshold (uint64 in and out)."""
    home, extra = fps.copy(), []
    for shift, mask, s, pats, ok in code():
        syn = s[((fps >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)]
        lead = pats[0][syn, 0]
        home ^= lead
        extra.append([(pats[e][syn] ^ lead[:, None], ok[e][syn]) for e in range(1, THRESHOLD + 1)])
    idx = np.arange(len(fps))
    anchors, of, at_home = [home], [idx], [np.ones(len(fps), bool)]

    def add(delta: np.ndarray, ok: np.ndarray) -> None:
        r, _ = np.nonzero(ok)
        anchors.append(home[r] ^ delta[ok])
        of.append(r)
        at_home.append(np.zeros(len(r), bool))

    for by_excess in extra:
        for delta, ok in by_excess:
            add(delta, ok)
    for (a, _), (b, _) in combinations(extra, 2):  # one more bit in each of two blocks
        add((a[0][:, :, None] ^ b[0][:, None, :]).reshape(len(fps), -1), (a[1][:, :, None] & b[1][:, None, :]).reshape(len(fps), -1))
    return np.concatenate(anchors), np.concatenate(of), np.concatenate(at_home)


@cache
def flips() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.concatenate([one, *(one[i] ^ one[i + 1 :] for i in range(63))])


def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For whole anchors, sorted by anchor: (fp, earlier fp) edges, a spanning forest of each anchor's links."""
    n = len(fp)
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((cut, [n])))
    label = np.arange(n)
    first, width = np.repeat(cut, size), np.repeat(size, size)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Labels fall to the least of both ends until nothing changes."""
        while len(a):
            ra, rb = label[a], label[b]
            odd = ra != rb
            a, b, ra, rb = a[odd], b[odd], ra[odd], rb[odd]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    rows = np.flatnonzero(home & (width > 1))
    large = width[rows] > 4096
    todo = rows[~large]
    ends = np.cumsum(width[todo])
    at = 0
    while at < len(todo):  # about 4 million comparisons a step
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), "right")))
        part = todo[at:to]
        w = width[part]
        i = np.repeat(part, w)
        j = np.repeat(first[part], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= THRESHOLD) & (i != j)
        join(i[near], j[near])
        at = to
    lo, order = -1, np.arange(0)
    for i in rows[large]:  # many members: look up each neighbour of a home fingerprint instead
        if first[i] != lo:  # rows come in the order of signed longs, the search needs unsigned values
            lo = first[i]
            order = lo + np.argsort(fp[lo : lo + width[i]])
            ranked = fp[order]
        probe = fp[i] ^ flips()
        k = np.searchsorted(ranked, probe)
        k[k == len(ranked)] = 0
        j = order[k[ranked[k] == probe]]
        join(np.full(len(j), i), j)
    odd = np.flatnonzero(label != np.arange(n))
    return fp[odd], fp[label[odd]]


def compare(batches: Iterator[pa.RecordBatch], split: int | None = None) -> Iterator[pa.RecordBatch]:
    """Links of a stream (anchor, fp, home) sorted by anchor and fp; the last anchor of a batch waits for the next.
    An anchor with more than split members isn't compared: one row (anchor, members, over = true) stands for it."""
    held: list[list[np.ndarray]] = []
    waiting, over, seen = 0, None, 0  # rows held; an anchor that is too large and its members so far

    def out(a: np.ndarray, f: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        u, v = links(a, f.view(np.uint64), h)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.zeros(len(u), bool))], ["u", "v", "over"])

    def marked() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([over], pa.int64()), pa.array([seen], pa.int64()), pa.array([True])], ["u", "v", "over"])

    for b in batches:
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)]
        if over is not None:
            more = int(np.searchsorted(cols[0], over, "right"))
            seen, cols = seen + more, [c[more:] for c in cols]
            if len(cols[0]):
                yield marked()
                over = None
        if not len(cols[0]):
            continue
        held.append(cols)
        waiting += len(cols[0])
        if waiting < STEP:
            continue
        a, f, h = (np.concatenate(x) for x in zip(*held, strict=True))
        to = int(np.searchsorted(a, a[-1], "left"))
        if to:
            yield out(a[:to], f[:to], h[:to])
        held, waiting = [[a[to:], f[to:], h[to:]]], len(a) - to
        if split and waiting > split:
            over, seen, held, waiting = int(a[-1]), waiting, [], 0
    if over is not None:
        yield marked()
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            anchor, of, home = replicas(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[of].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def near_links(unique: DataFrame, split: int = 0) -> DataFrame:
    """u, v: edges between distinct fingerprints whose components equal those of all links. split: SPLIT (tests: less)."""
    split, spark = split or SPLIT, unique.sparkSession
    kind = "u long, v long, over boolean"
    # a fingerprint is 8 bytes and becomes 90 rows: the number of tasks is given, not left to the size of the input
    reps = unique.select("fp").repartition(tasks(spark), "fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    found = stored(reps.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(lambda bs: compare(bs, split), kind), "simhash-links", compression="zstd")
    near = found.where("NOT over").select("u", "v")
    large = found.where("over").select(F.col("u").alias("anchor"), F.ceil(F.col("v") * 2 / split).cast("int").alias("parts"))
    if large.isEmpty():
        return near.distinct()
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = reps.join(large, "anchor").withColumn("part", part)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # task (i, j) of an anchor gets the home fingerprints of part i and all members of part j
    homes = rows.where("home").select("anchor", F.col("part").alias("i"), F.explode(every).alias("j"), "fp", "home")
    members = rows.select("anchor", F.explode(every).alias("i"), F.col("part").alias("j"), "fp", F.lit(False).alias("home"))
    cells = homes.union(members).select(F.xxhash64("anchor", "i", "j").alias("cell"), "fp", "home")
    return near.union(cells.repartition(tasks(spark), "cell").sortWithinPartitions("cell", "fp").mapInArrow(compare, kind).select("u", "v")).where("u <> v").distinct()


def near_dedup(docs: DataFrame, similarity: float | None = None, split: int = 0) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs. similarity: texts with this Jaccard similarity of 5-word shingles are linked too."""
    keys = stored(docs.select("doc_id", near_texts.key().alias("key")), "simhash-keys", compression="zstd") if similarity else None
    fps = stored(fingerprints(docs), "simhash-fps", compression="zstd")
    unique = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-unique", compression="zstd")
    comp = stored(components(near_links(unique, split)).withColumnRenamed("u", "fp"), "simhash-components", compression="zstd")
    # aggregates are written, so that the joins stand alone in their stages and a component or a fingerprint that many rows share can be split
    least = stored(comp.join(unique, "fp").groupBy("root").agg(F.min("first_id").alias("least_id")), "simhash-least", compression="zstd")
    of_fp = comp.join(least, "root").select("fp", "least_id")
    classes = stored(unique.join(of_fp, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "simhash-classes", compression="zstd")
    rows = fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return rows if keys is None else _with_near_texts(docs, keys, rows, similarity)


def _with_near_texts(docs: DataFrame, keys: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """rows with components that the links of near texts join. Needs distinct doc_ids."""
    rows = stored(rows, "simhash-rows", compression="zstd")
    linked = near_texts.linked(docs, similarity=similarity)
    own = stored(keys.join(linked.withColumnRenamed("_key", "key"), "key").select("doc_id", "root"), "simhash-near", compression="zstd")
    own = own.join(rows, "doc_id").select("root", "component_id").distinct()
    own = stored(own, "simhash-both", compression="zstd")
    hub = stored(own.groupBy("root").agg(F.min("component_id").alias("hub")), "simhash-hubs", compression="zstd")
    joined = stored(components(own.join(hub, "root").select(F.col("component_id").alias("u"), F.col("hub").alias("v"))).withColumnRenamed("root", "joined"), "simhash-joined", compression="zstd")
    return rows.join(joined, rows["component_id"] == joined["u"], "left").select("doc_id", "fingerprint", F.coalesce("joined", "component_id").alias("component_id"))
