"""Against a dictionary, with forced digest collisions."""

import hashlib
import re
from collections import defaultdict

from tessera.llm import op5_exact_dedup as op

ROWS = [(5, "a  b", "x"), (3, "a\tb", "y"), (9, "a b", None), (4, "", "x"), (2, None, "x"), (7, "A b", "x"), (7, "A b", "x"), (None, "lone", "x"), (11, "é b", "x"), (12, " lead", "x"), (13, "\x0blead", "x"), (14, "z " * 40000, "x")]


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, _ in rows]
    ids = defaultdict(list)
    for (i, _, _), t in zip(rows, norm):
        ids[t].append(i)
    out = []
    for (i, _, _), t in zip(rows, norm):
        keep = min((x for x in ids[t] if x is not None), default=None)
        out.append((i, keep, len(ids[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS + [(100 + k, f"many {k % 7}", "x") for k in range(200)], "doc_id long, text string, digest string")
    want = brute([(r.doc_id, r.text, None) for r in df.collect()])
    assert sorted(map(tuple, op.exact_dedup(df).collect()), key=repr) == want


def test_collisions_are_split_by_their_bytes(spark):
    df = spark.createDataFrame(ROWS + [(100 + k, f"many {k}", "x") for k in range(700)], "doc_id long, text string, digest string")
    want = brute([(r.doc_id, r.text, None) for r in df.collect()])
    assert sorted(map(tuple, op.exact_dedup(df, key_bytes=1).collect()), key=repr) == want


def test_empty_table(spark):
    assert op.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_batches_equal_one(spark):
    """Six batches, looked up and compacted on the way, against one; with keys that collide too."""
    rows = ROWS + [(1000 - k, f"many {k % 17}", "x") for k in range(120)] + [(2000 + k, f"own {k}", "x") for k in range(60)]
    for key_bytes in (32, 1):
        index = op.Index(key_bytes)
        for k in range(6):
            index.add(spark.createDataFrame(rows[k::6], "doc_id long, text string, digest string"))
            assert len(index.levels) < op.FANOUT
        assert sorted(map(tuple, index.decisions().collect()), key=repr) == brute(rows)


def test_filters_are_consulted(spark):
    """Of another batch's digests only those in an older level and few others pass its filter."""
    index = op.Index()
    index.add(spark.range(0, 3000).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    more = op.flush_runs(spark.range(2900, 5900).selectExpr("id AS doc_id", "concat('text ', id) AS text")).select("digest")
    passed = op.may_hit(more, index.levels[0].filter, index.levels[0].bits).count()
    assert 100 <= passed < 600


def test_levels_are_merged_in_order(spark):
    """Compaction has one exchange, by ranges: the aggregate works on what is sorted there."""
    index = op.Index()
    for k in range(2):
        index.add(spark.range(0, 100).selectExpr("id AS doc_id", f"concat('text ', id * {k + 1}) AS text"))
    plan = op.merged(index.levels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
