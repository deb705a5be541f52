"""Against the library, its model type turned to unigram, and exact round trips."""

import random

import pytest
import sentencepiece

from tessera.llm import op1_sentencepiece as op


def unigram_bytes():
    """The vocabulary file with trainer_spec.model_type = UNIGRAM: the same pieces and scores."""
    raw = open(op.default_model(), "rb").read()

    def varint(b, at):
        n = shift = 0
        while True:
            n |= (b[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not b[at - 1] & 128:
                return n, at

    def encoded(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out + bytes([n]))

    out, at = bytearray(), 0
    while at < len(raw):
        tag, body = varint(raw, at)
        assert tag & 7 == 2
        size, start = varint(raw, body)
        part = raw[start : start + size]
        if tag >> 3 == 2:  # trainer_spec: a later field 3 (model_type) wins
            part += encoded(3 << 3) + encoded(1)
        out += encoded(tag) + encoded(len(part)) + part
        at = start + size
    return bytes(out)


@pytest.fixture(scope="module")
def codec():
    return op.Codec(op.load(op.default_model()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=unigram_bytes())


TEXTS = ["", " ", "a", "hello world", "  two  spaces ", "line\nbreak\ttab", "naïve café Größe ciónñ", "日本語 テスト", "emoji 🙂 mix 🙂🙂", "\x00\x01 odd", "x" * 300, "internationalization of tokenizers", "1234567890 $%^&*", "</s> <s> <unk> <0x0A>"]


def test_equals_library_unigram(codec, library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abc de ñé🙂\nthe▁ ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    total = lambda ids: sum(codec.vocab.scores[i] for i in ids)
    same = 0
    for t in texts:
        ours, theirs = codec.encode(t).tolist(), library.encode(t)
        same += ours == theirs
        # some pieces score -1e9, where the library's single precision can't tell paths apart that differ by less than 64
        assert ours == theirs or total(ours) > total(theirs) >= total(ours) - 64, t
    assert same > 0.98 * len(texts)


def test_same_as_whole_text_viterbi(codec):
    """Cutting at spaces and remembering segments changes nothing."""
    for t in TEXTS[1:]:
        assert codec.encode(t).tolist() == list(codec.path(op.SPACE + t.replace(" ", op.SPACE)))


def test_best_path_by_brute_force():
    v = op.Vocabulary(("<unk>", "a", "b", "ab", "ba", "aba", "▁"), (0.0, -3.0, -3.0, -4.0, -3.5, -6.0, -1.0), "unnnnnn")
    c = op.Codec(v)
    score = dict(zip(v.pieces, v.scores))

    def best(s):
        if not s:
            return 0.0
        ways = [score[p] + best(s[len(p) :]) for p in v.pieces[1:] if s.startswith(p)]
        return max(ways, default=-16.0 + best(s[1:]))

    rng = random.Random(6)
    for _ in range(200):
        s = "".join(rng.choice("abab▁") for _ in range(rng.randint(1, 9)))
        ids = c.path(s)
        assert "".join(v.pieces[i] for i in ids) == s
        assert sum(v.scores[i] for i in ids) == pytest.approx(best(s))
    assert c.encode("zz a").tolist() == [6, 0, 6, 1]  # one unknown id a run


def test_round_trip(codec, library):
    for t in TEXTS:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        assert codec.decode(ids) == (library.decode(ids.tolist()) if not t.startswith(" ") else t)


def test_query(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 30000, 5), (4, "a b", 5), (4, "a b", 5), (None, "é🙂", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = op.encode_documents(df).collect()
    assert len(out) == 6 and all(r.round_trip for r in out)
    assert {r.doc_id: r.n_ids for r in out}[1] == 0
    texts = sorted(((r.doc_id or 0), r.decoded) for r in op.decoded(op.encode_documents(df)).collect())
    assert texts == sorted(((a or 0), b or "") for a, b, _ in rows)
    assert op.annotate(df.limit(0)).collect() == []
