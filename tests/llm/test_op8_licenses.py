"""Against all windows of all texts in plain Python."""

import random

from tessera.llm import op8_licenses as op


def brute(text):
    ws = op.template_words(text or "")
    sh = [" ".join(ws[i : i + op.SHINGLE]) for i in range(len(ws) - op.SHINGLE + 1)]
    out = {}
    for name, t in op.TEMPLATES.items():
        own, s = set(op.template_shingles(t)), len(op.template_shingles(t))
        held = [c for j in range(0, len(sh), s) if (c := len(own & set(sh[j : j + 2 * s])) / len(own)) >= op.CONTAINMENT]
        if held:
            out[name] = (max(held), len(held))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    filler = "under the sun we license nothing of the free software in terms that public code may use without version".split()
    texts = [None, "", "license", "Released under the MIT License."]
    for _ in range(150):
        parts = [rng.choice(filler) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(list(op.TEMPLATES.values())).split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(parts))
            parts[at:at] = t
        texts.append(" ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts))
    texts += ["word " * 20000 + op.TEMPLATES["GPL-3.0"] + " é" * 5000, texts[3]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "x")]
    got = sorted(((r.doc_id, r.license, round(r.containment, 9), r.n_windows) for r in op.licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()), key=repr)
    want = sorted(((i, n, round(c, 9), k) for i, t, _ in rows for n, (c, k) in brute(t).items()), key=repr)
    assert got == want and len(want) > 60
    assert op.licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_lose_nothing():
    words = op.anchors(op.TEMPLATES)
    for n, t in op.TEMPLATES.items():
        every = set(op.template_shingles(t))
        without = {s for s in every if not set(words[n]) & set(s.split())}
        assert len(without) / len(every) < op.CONTAINMENT


def test_edited_copies_of_whole_texts(spark):
    """Whole licenses as they lie in repositories, broken over comment lines and with words replaced: found down to a containment of 0.8."""
    rng = random.Random(3)
    rows, want = [], set()
    for name, text in op.TEMPLATES.items():
        if len(text.split()) < 60:
            continue
        for edits in (0, 1, 3, 40):
            ws = text.split()
            for _ in range(edits):
                ws[rng.randrange(len(ws))] = "edited"
            body = "\n".join(" * " + " ".join(ws[k : k + 11]) for k in range(0, len(ws), 11))
            rows.append((len(rows), f"/*\n * Copyright (c) 2020 Some One\n{body}\n */\nint main() {{ return 0; }}\n" + "more code here " * 50))
            want |= {(rows[-1][0], n, round(c, 9)) for n, (c, _) in brute(rows[-1][1]).items()}
    got = {(r.doc_id, r.license, round(r.containment, 9)) for r in op.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert {n for _, n, c in want if c < 1} >= {"MIT-text", "BSD-3-Clause", "ISC", "Zlib"} and max(i for i, _, _ in want) > 30


def test_templates_are_an_argument(spark):
    mine = {"own": "this sentence of ours is the only license that we know here", "none": "too short"}
    df = spark.createDataFrame([(1, f"x {mine['own']} y"), (2, "Released under the MIT License of ours")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.containment) for r in op.licenses(df, mine).collect()] == [(1, "own", 1.0)]
    assert op.licenses(df, {}).collect() == []
