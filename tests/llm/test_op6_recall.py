"""Recall on edited copies, by the share of the best alignment, against alignment of every copy with its item."""

import random

import numpy as np

from tessera.llm import op6_decontaminate as op


def edited(ws, rng, rate):
    """Words replaced, dropped and put in, each at a third of the rate."""
    out = []
    for w in ws:
        x = rng.random()
        if x < rate / 3:
            out.append(f"new{rng.randrange(10**6)}")
        elif x < 2 * rate / 3:
            continue
        elif x < rate:
            out += [w, f"more{rng.randrange(10**6)}"]
        else:
            out.append(w)
    return out


def test_recall_by_share(spark):
    rng = random.Random(11)
    words = [f"v{k}" for k in range(4000)]
    items, docs, share = [], [], {}
    for k in range(700):
        ws = [rng.choice(words) for _ in range(rng.choice([12, 20, 40, 80]))]
        copy = edited(ws, rng, rng.uniform(0, 0.6)) if k % 5 else [w if n % 4 else f"x{n}" for n, w in enumerate(ws)]
        ids = {w: n for n, w in enumerate(dict.fromkeys(ws))}
        share[k] = op.align(np.array([ids[w] for w in ws]), np.array([ids.get(w, -1) for w in copy] or [-1]))[0] / (op.MATCH * len(ws))
        items.append((k, " ".join(ws)))
        around = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(2)]
        docs.append((k, f"{around[0]} {' '.join(copy)} {around[1]}"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id for r in op.contaminated(df, bench).collect() if r.doc_id == r.item_id}
    for low, high, least in ((0.9, 1.01, 1.0), (0.8, 0.9, 1.0), (0.7, 0.8, 0.99), (0.6, 0.7, 0.97)):
        band = [k for k, x in share.items() if low <= x < high]
        assert len(band) > 30 and sum(k in found for k in band) >= least * len(band), (low, len(band), sum(k in found for k in band))
