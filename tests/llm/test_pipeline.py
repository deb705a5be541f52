"""Each stage on its own input against a plain reading of its rule."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from tests.llm.test_near_texts import linked
from tests.llm.test_op2_langid import text_of


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(1)
    item = " ".join(f"item{k}word" for k in range(20))
    rows = [(k, text_of(lang, rng, 80), lang, "s", 1, "extra") for k, lang in enumerate(["en", "de", "fr", "es"] * 15)]
    rows += [(100 + k, rows[k][1].replace(" ", "  \n"), "en", "s", 1, "extra") for k in range(6)]  # copies
    rows += [(200, rows[8][1] + " tail", "en", "s", 1, None), (201, f"some words {item} and more words", "en", "s", 1, None), (202, None, "en", "s", 1, None), (203, "12 34", "en", "s", 1, None)]
    rows += [(300, "twice the same row", "en", None, None, None)] * 2 + [(None, rows[1][1], "en", None, 1, None), (None, "lone text without id", "en", None, 1, None)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [tuple(r) for r in docs.collect()]
        docs = cp.stored(stage(spark, docs, made), "t")
        after = [tuple(r)[: len(columns)] for r in docs.collect()]
        assert docs.columns[: len(columns)] == columns and (len(docs.columns) == len(columns)) == (k < 4)
        assert set(after) <= set(before)
        if name == "language_id":
            want = [r for r in before if re.search(r"[^\W\d_]", r[1] or "")]
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")].append(r)
            want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
        elif name == "near_dedup":
            rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
            want = [r for i, (r, root) in enumerate(zip(rows, linked([r[1] for r in rows]), strict=True)) if root == i]
            assert len(want) < len(rows)
        elif name == "decontaminate":
            want = [r for r in before if r[0] != 201]
        else:
            want = before
            assert all(r.round_trip for r in docs.collect())
        assert sorted(after, key=repr) == sorted(want, key=repr), name
    assert docs.count() < 70


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_lose_no_text(spark):
    """One doc_id with several texts: of each text one row stays, the one with the smallest doc_id."""
    rows = [(3, "B b"), (5, "A a"), (5, "B  b"), (7, "C c"), (None, "C c"), (None, "D d"), (None, "D d"), (8, None), (9, " ")]
    kept = cp.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, "B b"), (5, "A a"), (7, "C c"), (None, "D d"), (8, None), (9, " ")], key=repr)
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, b), (5, a), (5, b + " "), (7, a + " "), (9, b), (None, a), (None, "only here and nowhere else")]
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, b), (5, a), (None, "only here and nowhere else")], key=repr)


def test_clashing_columns(spark, made):
    names = ["_sha", "_row", "_row_", "_items", "contamination", "in_contamination", "Score", "in_score", "lang_pred", "digest", "sha", "fp", "key", "row", "order", "component_id", "least"]
    text = spark.read.parquet(f"{made}/documents.parquet").where("doc_id = 0").first().text
    docs = spark.createDataFrame([(k, f"{text} {'once' * (k % 2)}", "en", *[f"{n}{k}" for n in names]) for k in range(3)], ["doc_id", "text", "lang", *names])
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, made)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(want[r[0]] == r for r in got), name
    op = cp.op6_decontaminate
    bench = spark.read.parquet(f"{made}/benchmark.parquet")
    rows = op.annotate(docs.drop("contamination"), bench, item_grams=1)
    assert rows.columns == [*docs.drop("contamination").columns, "contamination"] and rows.count() == 3
