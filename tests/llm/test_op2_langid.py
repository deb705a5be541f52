"""Gradients against finite differences, states against the training pass, accuracy on held-out text."""

import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import op2_langid as op

WORDS = {"en": "the and that with which from have this", "de": "der und nicht sich auch eine wird über", "fr": "le et que pour dans est une très", "es": "el que los para con una más año"}


def text_of(lang, rng, n=60):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [lang for lang in WORDS for _ in range(40)]
    return op.fit([text_of(lang, rng) for lang in langs], langs)


def test_gradients():
    rng = np.random.default_rng(0)
    H, x = 3, rng.integers(0, 256, (5, 4))
    w, u = rng.normal(0, 0.5, (257, 3 * H)), rng.normal(0, 0.5, (H, 3 * H))
    pick = rng.normal(0, 1, (5, 4, H)).astype(np.float32)
    loss = lambda w, u: float((op._scan(x, w, u)[0] * pick).sum())
    _, tape = op._scan(x, w, u, True)
    dw, du = op._scan_back(x, u, tape, pick)
    for a, d in ((w, dw), (u, du)):
        for _ in range(20):
            i = (x[rng.integers(5), rng.integers(4)] if a is w else rng.integers(H), rng.integers(3 * H))
            old, a[i] = a[i], a[i] + 1e-2
            up = loss(w, u)
            a[i] = old - 1e-2
            down = loss(w, u)
            a[i] = old
            assert d[i] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_reading_equals_training_states(model):
    x = np.random.default_rng(1).integers(0, 257, (op.BLOCK, 9))
    for d in "fb":
        a, _ = op._scan(x, model.params[f"w{d}"], model.params[f"u{d}"])
        b = op._states(x, op._gates(model.params[f"w{d}"], model.params[f"u{d}"]))
        assert np.allclose(a, b.transpose(0, 2, 1), atol=1e-4)


def plain(model, text):
    """Mean probabilities by a recurrence over the whole text, one byte and one unit after another."""
    p, H, raw = model.params, op.HIDDEN, text.encode()
    sig = lambda v: 1 / (1 + math.exp(-v))

    def states(bs, w, u):
        h, out = [0.0] * H, []
        for b in bs:
            dot = lambda j, v: sum(v[i] * float(u[i, j]) for i in range(H))  # noqa: B023, E731
            z = [sig(float(w[b, j]) + dot(j, h)) for j in range(H)]
            r = [sig(float(w[b, H + j]) + dot(H + j, h)) for j in range(H)]
            n = [math.tanh(float(w[b, 2 * H + j]) + r[j] * dot(2 * H + j, h)) for j in range(H)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(H)]
            out.append(h)
        return out

    fore, back = states(raw, p["wf"], p["uf"]), states(raw[::-1], p["wb"], p["ub"])[::-1]
    total = [0.0] * len(model.langs)
    for f, b in zip(fore, back, strict=True):
        q = [math.exp(float(p["c"][k]) + sum(v * float(p["o"][i, k]) for i, v in enumerate([*f, *b]))) for k in range(len(total))]
        total = [t + x / sum(q) for t, x in zip(total, q, strict=True)]
    return [t / len(raw) for t in total]


def test_states_and_pooling_against_a_plain_recurrence(model):
    """Short texts exactly; longer ones within what the gates keep beyond the warm-up."""
    rng = random.Random(6)
    texts = ["a", "ü", text_of("de", rng, 20)[: op.BLOCK - 20], text_of("fr", rng, 200), text_of("es", rng, 150) + text_of("en", rng, 150), "12 x"]
    for t, lang, score in zip(texts, *op.predict(model, texts), strict=True):
        want = plain(model, t)
        best = max(want)
        assert abs(score - best) < (1e-4 if len(t.encode()) <= op.BLOCK else 2e-3), t
        assert lang == model.langs[want.index(best)]


def test_every_position_counts(model):
    """Pooled probabilities are the means over positions, however texts are batched."""
    rng = random.Random(2)
    texts = [text_of(lang, rng, n) for lang in WORDS for n in (1, 7, 300)] + ["x" * 200_000]
    one = [op.predict(model, [t]) for t in texts]
    langs, scores = op.predict(model, texts)
    assert langs == [a[0] for a, _ in one] and np.allclose(scores, [b[0] for _, b in one], atol=1e-5)


def test_held_out_accuracy_and_edges(model):
    rng = random.Random(3)
    want = [lang for lang in WORDS for _ in range(30)]
    got, scores = op.predict(model, [text_of(lang, rng) for lang in want])
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)
    assert all(0 <= s <= 1 for s in scores)
    assert op.predict(model, [None, "", "12 %&", "  \n"]) == (["und"] * 4, [0.0] * 4)
    assert op.predict(op.fit([], []), ["some text"]) == (["und"], [0.0])


def test_query(spark):
    rng = random.Random(4)
    rows = [(i, text_of(lang, rng), lang, 0.5) for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(1000, None, "en", 0.0), (1001, "", "en", 0.0), (1002, "777", None, 0.0), (1002, "777", None, 0.0), (None, text_of("de", rng), "de", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = op.language_id(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in range(160):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(by[i].lang_pred == rows[i][2] for i in range(160)) >= 155
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[None].lang_pred == "de" and by[None].held_out is None
    assert op.language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in op.language_id(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
