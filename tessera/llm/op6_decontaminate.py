"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores, lower-cased. Every SEED-word n-gram of a test item that occurs
in a document is a seed, so any copy that keeps SEED words in a row holds one, however common the item is and
whatever other copies there are (the rarest n-grams would be those that an edit of this copy destroyed). Each seed
hit joins a passage of a document to an item; passages of one item that overlap are merged. A passage that has
fewer than SCORE of an item's words, in any order, can't reach SCORE and isn't aligned. Smith-Waterman (match 2,
mismatch -1, gap -1) over words then scores each passage, and the share of the best possible score, 2 * words of
the item, decides: at least SCORE is contamination.

An item with fewer than SEED words is its own seed, and documents are searched for n-grams of that size too. The
items are sent to the executors where their n-grams are at most ITEM_GRAMS; otherwise the n-grams of documents pass
a bitmap filter of the items' n-grams (FILTER_BITS, whatever the input), the rest meet in an equi-join, items travel
to a document in lots of LOT, and results are the same.

What is missed: copies at SCORE or more that keep no SEED words in a row (every third word replaced). The tests
measure recall on edited copies by the share of their alignment.

Defined cases: null and wordless texts (documents or items) match nothing. Repeated rows give repeated pairs; of
items with one item_id and text one counts. Items with one item_id and several texts: the best score counts, then
the first place. item_id is an integer. Very long texts are read whole. Empty tables: no rows. Extra columns are
ignored by contaminated() and kept by annotate(), whatever their names; a column contamination is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import extended, fresh, stored

SEED, SCORE = 3, 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: n-grams of items that are sent to every executor, about 200 bytes each.
ITEM_GRAMS = 200_000
#: Alignments remembered in one Python worker: copies of one passage are aligned once.
MEMO = 20_000
#: Bits of the filter that document n-grams pass before they meet items in a join (4 MB), and items in one lot.
FILTER_BITS, LOT = 1 << 25, 1000

words_of = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return words_of(text.lower()) if text else []


def grams(ws: list[str], size: int = SEED) -> list[str]:
    """n-grams of size words, in order, repeats included; fewer words are one n-gram."""
    if len(ws) < size:
        return [" ".join(ws)] if ws else []
    return [" ".join(g) for g in zip(*(ws[k:] for k in range(size)), strict=False)]


def sizes_of(items: Iterator[list[str]] | list[list[str]]) -> list[int]:
    """Sizes of n-grams that seeds have."""
    return sorted({min(SEED, len(ws)) for ws in items if ws})


def pick_seeds(gs: list[str], present: Container[str]) -> list[int]:
    """Positions of the n-grams that occur in a document."""
    return [k for k, g in enumerate(gs) if g in present]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score and its word range in passage. Linear gaps: a row's gaps are a running maximum."""
    n = len(passage)
    step = -GAP * np.arange(n + 1)
    h, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, a, b = 0, 0, 0
    for w in item:
        diag = h[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        own = np.concatenate(([0], np.maximum(np.maximum(diag, up), 0)))
        src = np.concatenate(([0], np.where((diag >= up) & (diag > 0), start[:-1], np.where(up > 0, start[1:], np.arange(1, n + 1)))))
        run = np.maximum.accumulate(own + step)
        at = np.maximum.accumulate(np.where(own + step == run, np.arange(n + 1), 0))
        h = np.maximum(run - step, 0)
        start = np.where(h > 0, src[at], np.arange(n + 1))
        k = int(h.argmax())
        if h[k] > best:
            best, a, b = int(h[k]), int(start[k]), k
    return best, a, b


@dataclass
class Index:
    """Items by number: (item_id, words); seeds: n-gram -> (item number, position)."""

    items: list[tuple[int, list[str]]]
    seeds: dict[str, list[tuple[int, int]]]
    sizes: list[int]
    memo: dict = field(default_factory=dict)

    def passages(self, ws: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Word ranges to align by item: around each seed hit the item may reach half its length beyond its ends."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        seeds = self.seeds
        for size in self.sizes:
            for at, g in enumerate(grams(ws, size)):
                if g in seeds:
                    for i, p in seeds[g]:
                        n = len(self.items[i][1])
                        found[i].append((max(0, at - p - n // 2), min(len(ws), at - p + n + n // 2 + 1)))
        for i, spans in found.items():
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                # passages of one hit each overlap; a chain of many hits is kept in pieces that still hold an item whole
                if a <= merged[-1][1] and b - merged[-1][0] <= 8 * len(self.items[i][1]) + 64:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            found[i] = [(a, b) for a, b in merged]
        return found

    def best(self, i: int, passage: list[str]) -> tuple[int, int, int]:
        key = (i, " ".join(passage))
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ids = {w: k for k, w in enumerate(dict.fromkeys(self.items[i][1]))}
            self.memo[key] = align(np.array([ids[w] for w in self.items[i][1]]), np.array([ids.get(w, -1) for w in passage]))
        return self.memo[key]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, score, first word, word behind the last) of contaminated items, one a item_id."""
        ws = words(text)
        out: dict[int, tuple[float, int, int]] = {}
        for i, spans in self.passages(ws).items():
            item_id, item = self.items[i]
            need = Counter(item)
            for a, b in spans:
                if (need & Counter(w for w in ws[a:b] if w in need)).total() / len(item) < SCORE:  # no alignment has more matches
                    continue
                score, x, y = self.best(i, ws[a:b])
                share = score / (MATCH * len(item))
                if share >= SCORE and (item_id not in out or (-share, a + x) < (-out[item_id][0], out[item_id][1])):
                    out[item_id] = (share, a + x, a + y)
        return sorted((i, *v) for i, v in out.items())


_index: dict[str, Index] = {}


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()


def occurring(docs: DataFrame, wanted: set[str], sizes: list[int]) -> set[str]:
    """The wanted n-grams that a document holds. Each task finds its own; the result is bounded by wanted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, seen = shared.value, set()
        for b in batches:
            for t in b.column(0):
                ws = words(t.as_py())
                for size in sizes:
                    seen.update(want.intersection(grams(ws, size)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["gram"])

    return {r.gram for r in docs.select("text").mapInArrow(run, "gram string").distinct().collect()}


def build_index(items: list[tuple[int, str]], present: Container[str]) -> Index:
    of = [(i, words(t)) for i, t in sorted(items)]
    index = Index(of, defaultdict(list), sizes_of([ws for _, ws in of]))
    for k, (_, ws) in enumerate(index.items):
        gs = grams(ws)
        for p in pick_seeds(gs, present):
            index.seeds[gs[p]].append((k, p))
    index.seeds = dict(index.seeds)
    return index


FIELDS = ("item_id", "score", "first_word", "end_word")
MATCHES = "array<struct<item_id: bigint, score: double, first_word: int, end_word: int>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))


def _found(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(FIELDS, m, strict=True)) for m in ms] for ms in rows], MATCH_TYPE)


def annotate(docs: DataFrame, benchmark: DataFrame, item_grams: int = ITEM_GRAMS) -> DataFrame:
    """docs with contamination (an array of matches, empty for clean documents) behind its columns."""
    keep = [c for c in docs.columns if c != "contamination"]
    docs, items = docs.select(*keep), _items(benchmark)
    # a gram needs a character and a blank at least: the sum bounds what is collected before it is collected
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > item_grams * 8:
        return _annotate_joined(docs, items)
    rows = [(r.item_id, r.text) for r in items.collect()]
    of = [words(t) for _, t in rows]
    index = build_index(rows, occurring(docs, {g for ws in of for g in grams(ws)}, sizes_of(of)))
    key, shared, at = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((index.items, index.seeds, index.sizes)), keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _index:
            _index.clear()
            _index[key] = Index(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _found([_index[key].matches(t.as_py()) for t in b.column(at)])], [*keep, "contamination"])

    return docs.mapInArrow(run, extended(docs, f"contamination {MATCHES}"))


def _hashed(gs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass")) % FILTER_BITS for g in gs), np.int64, len(gs))


def _bitmap(of_item: DataFrame) -> np.ndarray:
    """A filter of the items' n-grams, built by the executors; FILTER_BITS reach the driver, whatever the items."""
    at = of_item.select((F.col("bit") + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:  # a bucket has 2^15 bits
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out, bitorder="little").view(bool)


def _annotate_joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As annotate(), for items of any size: n-grams of documents and items meet in equi-joins."""
    keep, spark = docs.columns, docs.sparkSession
    row = fresh(keep, "_row")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
    texts = docs.select(F.col(row).alias("row"), "text")

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gs = list(dict.fromkeys(grams(words(t))))
                n, size = len(gs), min(SEED, len(words(t)))
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(gs, pa.string()), pa.array(_hashed(gs)), pa.array([size] * n, pa.int32())], ["item", "gram", "bit", "size"])

    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "decontaminate-texts")
    of_item = stored(items.select("item", "text").mapInArrow(item_rows, "item long, gram string, bit long, size int"), "decontaminate-items")
    sizes = sorted(r["size"] for r in of_item.select("size").distinct().collect())  # at most SEED
    shared = spark.sparkContext.broadcast(np.packbits(_bitmap(of_item)))

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for k in range(b.num_rows):
                ws = words(b.column(1)[k].as_py())
                gs = list({g for size in sizes for g in grams(ws, size)})
                gs = [g for g, x in zip(gs, live[_hashed(gs)].tolist(), strict=True) if x]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(gs), pa.int64()), pa.array(gs, pa.string())], ["row", "gram"])

    hits = texts.mapInArrow(doc_grams, "row long, gram string").join(of_item, "gram").select("row", "item").distinct()
    lots = hits.join(items, "item").groupBy("row", F.floor(F.col("item") / LOT).alias("lot")).agg(F.collect_list(F.struct("item_id", F.col("text").alias("own"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, own in zip(b.column(1), b.column(2), strict=True):
                own = [(x["item_id"], x["own"]) for x in own.as_py()]
                found.append(build_index(own, {g for _, x in own for g in grams(words(x))}).matches(t.as_py()))
            yield pa.RecordBatch.from_arrays([b.column(0), _found(found)], ["row", "contamination"])

    found = lots.join(texts, "row").select("row", "text", "items").mapInArrow(run, f"row long, contamination {MATCHES}")
    best = found.select("row", F.explode("contamination").alias("m")).groupBy("row", "m.item_id").agg(F.max_by("m", F.struct("m.score", -F.col("m.first_word"))).alias("m"))
    best = stored(best.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list("m")).alias("contamination")), "decontaminate-matches")
    none = F.array().cast(MATCHES)
    return docs.join(best, row, "left").select(*keep, F.coalesce("contamination", none).alias("contamination"))


def contaminated(docs: DataFrame, benchmark: DataFrame, item_grams: int = ITEM_GRAMS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: one row for each document and test item that it holds."""
    found = annotate(docs.select("doc_id", "text"), benchmark, item_grams).where(F.size("contamination") > 0)
    return found.select("doc_id", F.explode("contamination").alias("m")).select("doc_id", "m.*")
