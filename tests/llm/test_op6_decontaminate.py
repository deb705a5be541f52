"""Alignment against a cell-by-cell table; verdicts against alignment of every item with every whole document."""

import random

import numpy as np
import pytest

from tessera.llm import op6_decontaminate as op


def slow_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            s = op.MATCH if item[i - 1] == passage[j - 1] else op.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + op.GAP, h[i, j - 1] + op.GAP)
    return int(h.max())


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randint(1, 25))] for _ in range(2)]
        score, x, y = op.align(np.array(a), np.array(b))
        assert score == slow_align(a, b)
        if score:
            assert slow_align(a, b[x:y]) == score  # the range holds the alignment


def make(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(12)] + [(50, "two words"), (51, ""), (52, None), (3, "the other text of item three which is long enough")]
    docs = []
    for k in range(80):
        ws = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 2, 4])):  # edits: replace, drop, insert
                p = rng.randrange(len(part))
                part[p : p + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            part = part[: rng.choice([len(part), len(part), len(part) // 3])]
            at = rng.randint(0, len(ws))
            ws[at:at] = part
        docs.append((k, ", ".join(ws).upper() if k % 3 else " ".join(ws), None))
    docs += [(200, None, None), (201, "", None), (202, "Two  words", None), (202, "Two  words", None), (None, items[0][1], None), (203, ("filler " * 30000) + items[1][1], None)]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = make(random.Random(2))
    return spark.createDataFrame(docs, "doc_id long, text string, contamination string"), spark.createDataFrame(items + items[:2], "item_id long, text string"), docs, items


def test_verdicts(tables):
    df, bench, docs, items = tables
    want = {}
    for d, t, _ in docs:
        ws = op.words(t)
        for i, it in items:
            iw = op.words(it)
            if iw and ws:
                ids = {w: k for k, w in enumerate(dict.fromkeys(iw))}
                score = op.align(np.array([ids[w] for w in iw]), np.array([ids.get(w, -1) for w in ws]))[0] / (2 * len(iw))
                if score >= op.SCORE:
                    want[d, i] = max(score, want.get((d, i), 0))
    rows = op.contaminated(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    assert got == pytest.approx(want)
    assert len(rows) == len(want) + 1 and len(want) > 20  # document 202 comes twice
    large = op.contaminated(df, bench, item_grams=1).collect()
    assert sorted(map(repr, large)) == sorted(map(repr, rows))


def test_words_of_a_match(tables):
    df, bench, _, items = tables
    r = next(r for r in op.contaminated(df, bench).collect() if r.doc_id == 203)
    assert (r.first_word, r.end_word) == (30000, 30000 + len(op.words(items[1][1])))


def test_empty(tables):
    df, bench, _, _ = tables
    assert op.contaminated(df.limit(0), bench).collect() == []
    assert op.contaminated(df, bench.limit(0)).collect() == []


def test_edited_copies(spark):
    """A copy with each 6th word replaced, alone and beside an intact one: an item's edited n-grams are its rarest."""
    for n in (30, 60):
        ws = [f"w{k}x" for k in range(n)]
        edited = " ".join(f"other{k}" if k % 6 == 5 else w for k, w in enumerate(ws))
        bench = spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")
        for rows in ([(1, edited)], [(1, edited), (2, " ".join(ws))]):
            docs = spark.createDataFrame([*rows, (9, "nothing to see here at all")], "doc_id long, text string")
            for item_grams in (op.ITEM_GRAMS, 1):
                assert sorted(r.doc_id for r in op.contaminated(docs, bench, item_grams).collect()) == [d for d, _ in rows]


def test_random_edits(spark):
    """Of items with 15 % of the words replaced, every copy above the limit that keeps three words in a row is found."""
    rng = random.Random(5)
    items, docs, want = [], [], set()
    for k in range(120):
        ws = [f"i{k}w{x}" for x in range(rng.choice([12, 20]))]
        copy = [w if rng.random() >= 0.15 else f"e{x}" for x, w in enumerate(ws)]
        items.append((k, " ".join(ws)))
        docs.append((k, " ".join(copy)))
        ids = {w: x for x, w in enumerate(ws)}
        share = slow_align([ids[w] for w in ws], [ids.get(w, -1) for w in copy]) / (2 * len(ws))
        if share >= op.SCORE and set(op.grams(ws)) & set(op.grams(copy)):
            want.add(k)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for item_grams in (op.ITEM_GRAMS, 1):
        assert {r.doc_id for r in op.contaminated(df, bench, item_grams).collect()} == want
