"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a whole text in both directions. Every byte position gets a probability for
every language; a document's probabilities are the mean over all its positions. It is trained here, in numpy, by
backpropagation through time.

Reading: a text is cut into cores of BLOCK bytes that go through the network side by side. States run on across
cores: the forward direction starts WARM bytes before a core and the backward one WARM bytes behind it, from zero
states there, so that a position's states differ from those of one run over the whole text only by what the gates
keep for more than WARM bytes. The tests compare both with a plain recurrence over whole texts: scores agree within
0.002 and labels are the same. Texts up to BLOCK bytes are read exactly.

Training data: text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2. The fit takes a
bounded sample: of the SAMPLE rows with the smallest xxhash64(doc_id) the whole texts are cut into pieces of PIECE
characters, and PIECES of them are taken, each row giving its first, then its second and so on, in the order of a
hash of row and place. lang, source and doc_id are never inputs of a prediction.

Defined cases: null texts and texts without a letter get `und` and score 0. With no labelled text at all every
document is `und`. A null doc_id is held_out null and never trains. Very long texts are read whole, in steps of
bounded memory. Of languages with equal probabilities the first by name is taken.
Repeated rows give repeated rows. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import extended

SAMPLE, PIECE, PIECES = 4000, 96, 28_800
HIDDEN, TRAINED, BATCH, STEPS, RATE, SEED = 8, 128, 96, 300, 0.02, 7
BLOCK, WARM = 256, 64
PAD, STEP = 256, 2048
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


@dataclass
class Model:
    """langs; for each direction the gate inputs by byte (257 x 3H, 256: padding) and recurrent weights (H x 3H), gates z, r, n; output weights and bias."""

    langs: list[str]
    params: dict[str, np.ndarray]


@np.errstate(over="ignore")
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _split(a: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(x) for x in np.split(a, 3, axis=1)]


def _scan(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of one direction for byte columns x (T x B). keep: also what backpropagation needs."""
    (wz, wr, wn), (uz, ur, un) = _split(w), _split(u)
    wz[PAD], wr[PAD], wn[PAD] = 30, 0, 0  # padding leaves a state as it is
    h = np.zeros((x.shape[1], u.shape[0]), np.float32)
    out, tape = np.empty((*x.shape, u.shape[0]), np.float32), []
    for t in range(len(x)):
        z, r = _sigmoid(wz[x[t]] + h @ uz), _sigmoid(wr[x[t]] + h @ ur)
        c = h @ un
        n = np.tanh(wn[x[t]] + r * c)
        if keep:
            tape.append((h, z, r, c, n))
        h = n + z * (h - n)
        out[t] = h
    return out, tape


def _scan_back(x: np.ndarray, u: np.ndarray, tape: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and of the recurrent weights."""
    H = u.shape[0]
    uz, ur, un = _split(u)
    dw, du = np.zeros((257, 3 * H), np.float32), np.zeros_like(u)
    dh, gs = np.zeros_like(dout[0]), np.empty((*x.shape, 3 * H), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, n = tape[t]
        dh = dh + dout[t]
        dz, dn = dh * (h - n) * z * (1 - z), dh * (1 - z) * (1 - n * n)
        dr, dc = dn * c * r * (1 - r), dn * r
        np.concatenate([dz, dr, dn], axis=1, out=gs[t])
        du += h.T @ np.concatenate([dz, dr, dc], axis=1)
        dh = dh * z + dz @ uz.T + dr @ ur.T + dc @ un.T
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[order], return_index=True)
    dw[used] = np.add.reduceat(gs.reshape(-1, 3 * H)[order], first, axis=0)
    return dw, du


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Train on pairs; deterministic. No pairs: a model without languages."""
    names = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    blocks, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        b = np.frombuffer(t.encode("utf-8", "replace"), np.uint8).astype(np.int64)
        b = np.concatenate([b, np.full(-len(b) % TRAINED, PAD)]).reshape(-1, TRAINED)
        blocks.append(b)
        ys.append(np.full(len(b), names.index(lang)))
    H, L = HIDDEN, len(names)
    p = {f"{k}{d}": rng.normal(0, s, shape).astype(np.float32) for d in "fb" for k, s, shape in (("w", 0.3, (257, 3 * H)), ("u", 0.3, (H, 3 * H)))}
    p |= {"o": rng.normal(0, 0.3, (2 * H, L)).astype(np.float32), "c": np.zeros(L, np.float32)}
    if not blocks:
        return Model(names, p)
    X, Y = np.concatenate(blocks), np.concatenate(ys)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    while step < STEPS:
        order = rng.permutation(len(X))
        for at in range(0, min(len(X), (STEPS - step) * BATCH), BATCH):
            pick = order[at : at + BATCH]
            x, y = np.ascontiguousarray(X[pick].T), Y[pick]
            hf, tf = _scan(x, p["wf"], p["uf"], True)
            hb, tb = _scan(x[::-1], p["wb"], p["ub"], True)
            h = np.concatenate([hf, hb[::-1]], axis=2)
            q = _softmax(h @ p["o"] + p["c"])
            q[:, np.arange(len(y)), y] -= 1
            q *= (x != PAD)[:, :, None] / np.float32((x != PAD).sum())
            dh = q @ p["o"].T
            g = {"o": np.tensordot(h, q, ([0, 1], [0, 1])), "c": q.sum(axis=(0, 1))}
            g["wf"], g["uf"] = _scan_back(x, p["uf"], tf, dh[:, :, :H])
            g["wb"], g["ub"] = _scan_back(x[::-1], p["ub"], tb, dh[::-1, :, H:])
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / STEPS)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k in p:
                a = g[k] * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] = (p[k] - rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, p)


def _gates(w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights for _states: turned, and scaled so that 1 / (1 + exp(.)) gives z, r and (n + 1) / 2."""
    w = w.copy()
    H = u.shape[0]
    w[PAD] = [30] * H + [0] * 2 * H
    wt, ut = np.ascontiguousarray(w.T), np.ascontiguousarray(u.T)
    return -wt[: 2 * H], -2 * wt[2 * H :], -ut[: 2 * H], -2 * ut[2 * H :]


@np.errstate(over="ignore")
def _states(x: np.ndarray, gates: tuple) -> np.ndarray:
    """As _scan, for reading only: states T x H x B, with buffers that are used again."""
    wzr, wn, uzr, un = gates
    H, B = len(un), x.shape[1]
    out = np.empty((len(x), H, B), np.float32)
    h, zr, n, c = np.zeros((H, B), np.float32), np.empty((2 * H, B), np.float32), np.empty((H, B), np.float32), np.empty((H, B), np.float32)
    g = np.empty((2 * H, B), np.float32)
    for t in range(len(x)):
        np.matmul(uzr, h, out=zr)
        np.matmul(un, h, out=c)
        zr += wzr.take(x[t], axis=1, out=g, mode="clip")
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c *= zr[H:]
        c += wn.take(x[t], axis=1, out=n, mode="clip")
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        np.subtract(h, c, out=n)
        n *= zr[:H]
        np.add(n, c, out=out[t])
        h = out[t]
    return out


def lanes(raw: np.ndarray) -> np.ndarray:
    """Cores of BLOCK bytes with WARM bytes before and behind them, padded outside the text: cores x (WARM + BLOCK + WARM)."""
    n = -(-len(raw) // BLOCK)
    whole = np.full(n * BLOCK + 2 * WARM, PAD, np.int16)
    whole[WARM : WARM + len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(whole, BLOCK + 2 * WARM)[::BLOCK]


def positions(model: Model, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Language probabilities (L x B) of one byte position of the cores after another, for lanes (B x T)."""
    x, p = np.ascontiguousarray(rows.T.astype(np.intp)), model.params
    hf = _states(x[: WARM + BLOCK], _gates(p["wf"], p["uf"]))[WARM:]
    hb = _states(x[WARM:][::-1], _gates(p["wb"], p["ub"]))[WARM:]
    of, ob = np.ascontiguousarray(p["o"][:HIDDEN].T), np.ascontiguousarray(p["o"][HIDDEN:].T)
    for t in range(BLOCK):
        q = of @ hf[t]
        q += ob @ hb[BLOCK - 1 - t]
        q += p["c"][:, None]
        np.exp(q, out=q)  # states lie in (-1, 1), so q is bounded
        q /= q.sum(axis=0)
        yield q


def pooled(model: Model, rows: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities of each core: B x L."""
    live, total = rows[:, WARM : WARM + BLOCK].T != PAD, 0
    full = live.all(axis=1)
    for t, q in enumerate(positions(model, rows)):
        total = total + (q if full[t] else q * live[t])
    return total.T


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text. Cores of many texts go through the network together, STEP at a time."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    live = [i for i, t in enumerate(texts) if t and model.langs and LETTER.search(t)]
    sums, at, waiting, size = np.zeros((len(texts), max(1, len(model.langs)))), [], [], 0
    counts = np.zeros(len(texts), np.int64)

    def flush() -> None:
        nonlocal at, waiting, size
        blocks, of = np.concatenate(waiting), np.concatenate(at)
        for k in range(0, len(blocks), STEP):
            b, o = blocks[k : k + STEP], of[k : k + STEP]
            np.add.at(sums, o, pooled(model, b))
        at, waiting, size = [], [], 0

    for i in live:
        raw = np.frombuffer(texts[i].encode("utf-8", "replace"), np.uint8)
        counts[i] = len(raw)
        rows = lanes(raw)
        for k in range(0, len(rows), STEP):
            b = rows[k : k + STEP]
            waiting.append(b)
            at.append(np.full(len(b), i))
            size += len(b)
            if size >= STEP:
                flush()
    if waiting:
        flush()
    for i in live:
        k = int(sums[i].argmax())
        langs[i], scores[i] = model.langs[k], min(1.0, float(sums[i][k] / counts[i]))
    return langs, scores


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that aren't held out."""
    h = F.xxhash64(F.col("doc_id"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(h.alias("h"), "text", "lang")
    last = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return fit([], [])
    # pieces of whole texts: (round, hash, piece), a row's pieces in the order of their hashes
    places = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE)), lambda k: F.struct(F.xxhash64("h", k).alias("order"), k.alias("place")))
    pieces = rows.where((F.col("h") <= last) & (F.length("text") > 0)).select("h", "lang", "text", F.posexplode(F.array_sort(places)).alias("round", "at"))
    pieces = pieces.select("round", "at.order", "lang", F.substring("text", (F.col("at.place") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("text"))
    sample = pieces.orderBy("round", "order", "lang", "text").limit(PIECES).collect()  # PIECES * PIECE characters at most
    sample = [(r.text, r.lang) for r in sample if LETTER.search(r.text)]
    return fit([t for t, _ in sample], [lang for _, lang in sample])


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score behind its columns; those names are replaced where docs has them."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*keep)
    at = keep.index("text")
    schema = extended(docs, "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                lang, score = predict(model, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    return annotate(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs)).select("doc_id", "held_out", "lang_pred", "score")
