"""SentencePiece encoding and decoding.

Encoding: an Aho-Corasick automaton over the pieces drives one pass over the characters; at each position the
matches that end there (the automaton's output links, longest first) relax the best score of that position, and
the best path is read back: the segmentation with the greatest sum of piece scores. Ties go to the longer last
piece. A character that no piece covers becomes its UTF-8 byte pieces where the vocabulary has them, else the
unknown id (one per run). A space turns into U+2581 and one is put in front of a text that isn't empty.

Where no piece has U+2581 behind another character (checked when the vocabulary is loaded), the best path has a
cut before every run of U+2581, so texts are cut there and the paths of segments are remembered in a bounded
table: words repeat. This changes no result.

The vocabulary in PIECES is of the merge kind. The method named here takes the greatest sum of scores, as the
library does for the same pieces and scores once its model type says unigram; tests hold both against each
other (sums are doubles here, single precision there). It differs from the library's merge order on that file.

Decoding: pieces are joined, byte pieces are decoded as UTF-8 (invalid bytes become U+FFFD), U+2581 turns into a
space, and the one space in front goes. decode(encode(t)) == t for every text without U+2581 or lone surrogates.

Defined cases: null and empty texts have no ids and round_trip true (null decodes to the empty text). Very long
texts are read whole, their memory is bounded by the segment and the ids. Repeated rows give repeated rows.
Empty table: no rows. Extra columns are ignored by the query and kept by annotate().
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import extended

SPACE = "▁"
#: The library puts unknown characters this far below the least piece score.
UNKNOWN_PENALTY = 10.0
#: Segments remembered in one Python worker, and the longest that is remembered.
MEMO, MEMO_CHARS = 300_000, 48


@dataclass(frozen=True)
class Vocabulary:
    """Piece texts and scores by id; kind: n normal, b byte, u unknown, x never matched (control)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str


def default_model() -> str:
    """The public 32k vocabulary of this machine, a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model_file: str) -> Vocabulary:
    """Read pieces and scores of a SentencePiece model file (on the driver; they are sent to the executors)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.vocab_size())
    kind = lambda i: "u" if sp.is_unknown(i) else "b" if sp.is_byte(i) else "x" if sp.is_control(i) else "n"
    return Vocabulary(tuple(map(sp.id_to_piece, ids)), tuple(map(sp.get_score, ids)), "".join(map(kind, ids)))


@dataclass
class Codec:
    vocab: Vocabulary
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocab
        self.auto = ahocorasick.Automaton()
        live = [i for i, k in enumerate(v.kinds) if k == "n"]
        for i in live:
            self.auto.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        self.auto.make_automaton()
        self.singles = {v.pieces[i] for i in live if len(v.pieces[i]) == 1}
        self.lowest = min((v.scores[i] for i in live), default=0.0) - UNKNOWN_PENALTY
        self.unknown = max(0, v.kinds.find("u"))
        self.bytes = {int(v.pieces[i][1:-1], 16): i for i, k in enumerate(v.kinds) if k == "b"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.texts = [p.replace(SPACE, " ") if k == "n" else "⁇" if k == "u" else "" for p, k in zip(v.pieces, v.kinds, strict=True)]
        apart = not any(SPACE in v.pieces[i].lstrip(SPACE) for i in live)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s:.+)").findall

    def path(self, s: str) -> tuple[int, ...]:
        """Ids of the best path through one segment."""
        n = len(s)
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        if self.singles.issuperset(s):  # each position can be reached by a piece
            for end, piece in self.auto.iter(s):
                score = best[end + 1 - piece[0]] + piece[1]
                if score > best[end + 1]:
                    best[end + 1], back[end + 1] = score, piece
        else:
            at = 0  # positions up to here also have their unknown character's way, unless a piece covers that character
            for end, piece in chain(self.auto.iter(s), [(n, None)]):
                while at < end:
                    if s[at] not in self.singles and (score := best[at] + self.lowest) > best[at + 1]:
                        best[at + 1], back[at + 1] = score, (1, 0.0, -1)
                    at += 1
                if piece and (score := best[end + 1 - piece[0]] + piece[1]) > best[end + 1]:
                    best[end + 1], back[end + 1] = score, piece
        out: list[int] = []
        while n:
            size, _, i = back[n]
            out.append(i if i >= 0 else ~n)
            n -= size
        out.reverse()
        return tuple(out) if min(out, default=0) >= 0 else tuple(self._spell(out, s))

    def _spell(self, path: list[int], s: str) -> Iterator[int]:
        """Unknown characters (~end position) become bytes, or one unknown id a run."""
        last = False
        for i in path:
            if i >= 0:
                yield i
            elif len(self.bytes) == 256:
                yield from (self.bytes[b] for b in s[~i - 1].encode("utf-8", "surrogatepass"))
            elif not last:
                yield self.unknown
            last = i < 0

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        memo = self.memo
        for s in self.cut(SPACE + text.replace(" ", SPACE)):
            ids = memo.get(s)
            if ids is None:
                ids = self.path(s)
                if len(s) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[s] = ids
            out.extend(ids)
        return out

    def decode(self, ids: array | list[int]) -> str:
        texts, byte_of = self.texts, self.byte_of
        if byte_of and not byte_of.keys().isdisjoint(ids):
            parts, run = [], bytearray()
            for i in ids:
                if (b := byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(texts[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        else:
            text = "".join([texts[i] for i in ids])
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    """One codec in a Python worker: it keeps its memo from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _send(spark, model_file: str | None) -> tuple[str, object]:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(load(model_file or default_model()))  # bounded by the vocabulary


def annotate(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """docs with ids (array<int>), n_ids and round_trip behind its columns; those names are replaced where docs has them."""
    key, shared = _send(docs.sparkSession, model_file)
    new = ("ids", "n_ids", "round_trip")
    keep = [c for c in docs.columns if c not in new]
    docs = docs.select(*keep)
    at = keep.index("text")
    schema = extended(docs, "ids array<int>, n_ids int, round_trip boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                values, sizes, same = array("i"), [], []
                for t in b.column(at).to_pylist():
                    ids = codec.encode(t)
                    values.extend(ids)
                    sizes.append(len(ids))
                    same.append(codec.decode(ids) == (t or ""))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, np.int32) if len(values) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.array(sizes, np.int32)), pa.array(same)], [*keep, *new])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model_file: str | None = None) -> DataFrame:
    """rows with an array<int> column ids, and the text that it decodes to in column decoded."""
    key, shared = _send(rows.sparkSession, model_file)
    keep = [c for c in rows.columns if c != "decoded"]
    rows, at = rows.select(*keep), keep.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(i or []) for i in b.column(at).to_pylist()], pa.string())], [*keep, "decoded"])

    return rows.mapInArrow(run, extended(rows, "decoded string"))


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_ids, round_trip, ids of every row of docs."""
    return annotate(docs.select("doc_id", "text"), model_file).select("doc_id", "n_ids", "round_trip", "ids")
