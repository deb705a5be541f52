"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of letters and digits of the lower-cased text, shingles have SHINGLE words. For a template of s
shingles a text is read in windows of 2s shingles that start every s shingles, so an occurrence of the whole
template lies inside one window. Every window gets HASHES MinHash values, each a band of its own; a template is
retrieved where one band agrees. A window that holds CONTAINMENT of a template has a Jaccard similarity of at
least 0.8 s / 2.2 s, hence is retrieved with a probability of 1 - (1 - 0.363)^32 > 0.9999994, and one that holds
all of it with 1 - 2^-32. Verification is exact: distinct shared shingles / distinct shingles of the template.

Work is saved only where nothing can be lost: for each template anchor words are chosen that more of its shingles have
than a window with CONTAINMENT can lack. Texts and windows without an anchor word of a template can't hold it.
DataFrame operations only; everything happens inside a row, so there is no shuffle.

Templates are an argument, {name: text}. The default ones (license_texts) are notices, file headers and the whole
texts of the common short licenses; the long ones (Apache-2.0, GPL, MPL, CC) are found by their notices and headers
unless the caller gives their texts. What is in a row's plan grows with the templates' words.

Result: one row for each document and license found, with the best containment and the number of windows that
hold it. Defined cases: null, empty and shorter texts have no shingles and no rows. Very long texts are read
whole. Repeated rows give repeated rows. Empty table, or no template of five words: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import computed
from tessera.llm.license_texts import TEMPLATES

SHINGLE, HASHES, CONTAINMENT = 5, 32, 0.8

#: Words so common that they make poor anchors; they are taken only where a shingle has no other.
COMMON = frozenset("a all an and any are as at be by can for from i if in is it may no not of on or so than that the this to use v was we with you 0 1 2 3 4".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(text: str) -> list[str]:
    ws = template_words(text)
    return [" ".join(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)]


def anchors(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """For each template words of which so many shingles have one that no window with CONTAINMENT can miss them all: long words first, common ones last."""
    out = {}
    for name, text in templates.items():
        every = set(template_shingles(text))
        left, own = set(every), []
        # a window with CONTAINMENT lacks at most this many shingles
        while len(every) - len(left) <= math.floor((1 - CONTAINMENT) * len(every) + 1e-9):
            w = min({w for s in left for w in s.split()}, key=lambda w: (w in COMMON, -len(w), w))
            own.append(w)
            left = {s for s in left if w not in s.split()}
        out[name] = sorted(own)
    return out


def hashed(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def shingle_at(i: Column) -> Column:
    """The shingle that starts at word i of w. Single words are looked up: a slice would copy the whole array each time."""
    return F.concat_ws(" ", *[F.get("w", i + k) for k in range(SHINGLE)])


def signature(values: Column) -> Column:
    """MinHash values of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.array_min(F.transform(values, lambda h: F.xxhash64(h, k))))


def template_signatures(spark: SparkSession, templates: Mapping[str, str]) -> dict[str, list[int]]:
    """MinHash values of the templates by the same expression as for windows; bounded by the templates."""
    rows = ", ".join("({}, array({}))".format(repr(n), ", ".join(f"'{s}'" for s in template_shingles(t))) for n, t in templates.items())
    return {r.name: list(r.sig) for r in spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, shingles)").select("name", signature(F.transform("shingles", hashed)).alias("sig")).collect()}


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _held(s: int, own: list[str], words: list[str], sig: list[int]) -> Column:
    """Containments of at least CONTAINMENT in the windows for a template of s shingles (w: words, n: shingles, at: places of anchors, hs: shingle hashes)."""
    # window j has the shingles j * s .. j * s + 2s - 1, that is 2s + 4 words, with one of the template's anchor words in them
    at = F.filter("at", lambda p: F.array_contains(_strings(words), F.get("w", p)))
    near = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.floor((p - (2 * s + SHINGLE - 2)) / s), F.lit(0)), F.floor(p / s)))))
    near = F.filter(near, lambda j: j * s < F.col("n"))
    signed = F.array(*[F.lit(int(x)) for x in sig])

    def over(j: Column, of) -> Column:
        return F.transform(F.sequence(j * s, F.least(j * s + 2 * s, F.col("n")) - 1), lambda i: of(i.cast("int")))

    def retrieved(j: Column) -> Column:
        own = F.array(over(j, lambda i: F.get("hs", i)))  # a list of one window, so that its hashes are gathered once
        return F.exists(own, lambda v: F.exists(F.zip_with(signature(v), signed, lambda a, b: a == b), lambda y: y))

    def window(j: Column) -> Column:
        return over(j, shingle_at)

    candidates = F.filter(near, retrieved)
    held = F.transform(candidates, lambda j: F.size(F.array_intersect(window(j), _strings(own))) / F.lit(float(len(own))))
    return F.filter(held, lambda c: c >= CONTAINMENT)


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, n_windows for every license found in a row of docs."""
    templates = {n: t for n, t in templates.items() if template_shingles(t)}
    if not templates:
        return docs.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("n_windows"))
    sigs, words = template_signatures(docs.sparkSession, templates), anchors(templates)
    every = sorted({w for ws in words.values() for w in ws})
    low = F.lower("text")
    rows = docs.select("doc_id", low.alias("low")).where(F.greatest(*[F.col("low").contains(w) for w in every], F.lit(False), F.lit(False)))
    rows = computed(rows, w=F.regexp_extract_all("low", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).drop("low")
    places = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(_strings(every), x), i)), lambda i: i.isNotNull())
    rows = computed(rows, n=F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0)), at=places).where((F.col("n") > 0) & (F.size("at") > 0))
    rows = computed(rows, hs=F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: hashed(shingle_at(i))))
    found = [F.struct(F.lit(name).alias("license"), _held(len(template_shingles(t)), sorted(set(template_shingles(t))), words[name], sigs[name]).alias("held")) for name, t in templates.items()]
    rows = rows.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: F.size(x["held"]) > 0)).alias("f"))
    return rows.select("doc_id", F.col("f.license").alias("license"), F.array_max("f.held").alias("containment"), F.size("f.held").alias("n_windows"))


def sql(templates: Mapping[str, str] = TEMPLATES) -> str:
    """All windows of all texts, without bands."""
    rows = ", ".join(f"('{n}', {len(template_shingles(t))}, '{s}')" for n, t in templates.items() for s in sorted(set(template_shingles(t))))
    return rf"""
WITH t(license, size, shingle) AS (VALUES {rows}),
k AS (SELECT license, any_value(size) AS size, count(*) AS own FROM t GROUP BY license),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
i AS (SELECT doc_id, r, w, unnest(range(1, length(w) - {SHINGLE - 2})) AS p FROM d),
s AS (SELECT doc_id, r, p - 1 AS p, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS shingle FROM i),
h AS (SELECT s.doc_id, s.r, s.p, t.license, t.size, t.shingle FROM s JOIN t ON s.shingle = t.shingle),
j AS (SELECT *, p // size AS j FROM h UNION ALL SELECT *, p // size - 1 FROM h WHERE p >= size),
c AS (SELECT r, any_value(doc_id) AS doc_id, license, j, count(DISTINCT shingle) AS n FROM j GROUP BY r, license, j)
SELECT c.doc_id, c.license, max(n / own::double) AS containment, count(*)::int AS n_windows
FROM c JOIN k ON c.license = k.license WHERE n / own::double >= {CONTAINMENT} GROUP BY c.r, c.doc_id, c.license
"""
