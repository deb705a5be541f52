"""Vector expressions in double precision."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where sizes differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def display_distance(similarity: Column) -> Column:
    """1 - similarity, held to [0, 2]."""
    return F.least(F.greatest(1 - similarity, F.lit(0.0)), F.lit(2.0))


def hashed_bag(tokens: Column, size: int = 64) -> Column:
    """Deterministic embedding of tokens: counts by the first 4 hex digits of sha256 mod size. Give it a computed() column."""
    bucket = F.transform(tokens, lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 4), 16, 10).cast("int") % size)
    ones = F.transform(F.array(bucket), lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(b, lambda x: x == k)).cast("double")))
    return F.element_at(ones, 1)


def hashed_bags(df: DataFrame, key: str, text: str = "text", size: int = 64, memo: int = 500_000) -> DataFrame:
    """id, embedding: hashed_bag of the words of every text in one pass; a worker remembers the buckets of up to `memo` words."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = re.compile(r"\w+").findall, {}
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out = np.zeros((part.num_rows, size))
                for r, t in enumerate(part.column(1).to_pylist()):
                    ws = words((t or "").lower())
                    for w in ws:
                        if w not in known:
                            if len(known) >= memo:
                                known.clear()
                            known[w] = int(hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) % size
                        out[r, known[w]] += 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "embedding"])

    return df.select(key, text).mapInArrow(run, f"id {kind}, embedding array<double>")
