"""The stage's near copies against all-pairs Jaccard over 5-word shingles."""

import random

import numpy as np

import corpus_pipeline as cp
from tessera.llm import near_texts
from tests.llm.test_op7_simhash import brute, slow_fingerprint


def slow_roots(texts):
    """Least position reachable by pairs of 5-word Jaccard 0.8 or more."""
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def linked(texts):
    """Least position reachable by links of at most two bits or of a 5-word Jaccard of 0.8 or more."""
    root = list(range(len(texts)))
    for own in (brute([slow_fingerprint(t) for t in texts]), slow_roots(texts)):
        for i, r in enumerate(own):
            old, new = max(root[i], root[r]), min(root[i], root[r])
            root = [new if x == old else x for x in root]
    return root


def planted(rng):
    """Per text: copies with one to nine edited words, so that pairs lie on both sides of 0.8; chains of edits too."""
    texts = []
    for k in range(20):
        ws = [f"t{k}w{rng.randrange(300)}" for _ in range(rng.choice([3, 40, 120, 300]))]
        texts.append(" ".join(ws))
        for n in range(1, 10):
            copy = texts[-1].split() if k % 2 else list(ws)
            for _ in range(n):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def test_stage_drops_near_copies(spark):
    rng = random.Random(1)
    texts = planted(rng)
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(i, texts[j]) for i, j in enumerate(order)]
    roots = linked([t for _, t in rows])
    got = {r.doc_id for r in cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {i for i, r in enumerate(roots) if r == i}
    assert 20 < len(got) < len(texts) - 40


def test_a_group_is_split_by_labels(spark):
    """With no star round all pairs are compared; the components are the same."""
    texts = planted(random.Random(2))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want, stars = {tuple(r) for r in near_texts.linked(df).collect()}, near_texts.STARS
    try:
        near_texts.STARS = 0
        assert {tuple(r) for r in near_texts.linked(df).collect()} == want
    finally:
        near_texts.STARS = stars


def test_split_buckets_give_the_same_components(spark, monkeypatch):
    """Buckets in many parts, with and without star rounds."""
    texts = planted(random.Random(3))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {tuple(r) for r in near_texts.linked(df).collect()}
    monkeypatch.setattr(near_texts, "SPLIT", 3)
    monkeypatch.setattr(near_texts, "STARS", 0)
    assert {tuple(r) for r in near_texts.linked(df).collect()} == want


def test_sketches_lose_no_similar_pair():
    """Pairs at or above 0.8 pass whatever their sizes; sets across a doubling of the sketch too; most others don't."""
    rng = np.random.default_rng(4)
    passed = others = 0
    for n in (1, 4, 9, 100, 800, 1023, 1024, 1030, 1200, 2047, 2060, 9000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for lost in (0, 0.02, 0.1, 0.15, 0.2, 0.3, 0.5):
            for added in (0, 0.05, 0.1, 0.2, 0.4):
                other = np.unique(np.concatenate((base[int(lost * n) :], rng.integers(0, 2**63, int(added * n)).astype(np.uint64))))
                if not len(other):
                    continue
                same = len(np.intersect1d(base, other))
                similar = same / (len(base) + len(other) - same) >= 0.8
                cols = [np.array([5, 3]), np.array([5, 3]), np.array([len(base), len(other)]), np.array([3, 3])]
                of = np.array([near_texts.sketch(base), near_texts.sketch(other)], object)
                got = [(a.tolist(), b.tolist()) for a, b in near_texts.close(*cols, of, 0.8)]
                assert got in ([], [([3], [5])])
                assert got or not similar
                if not similar:
                    others, passed = others + 1, passed + bool(got)
    assert passed < others / 4
