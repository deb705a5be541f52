"""Round trips of hostile texts, digests against plain Python, and a conversation that spans segments."""

import hashlib
import random

from tessera.llm import op10_chat as op

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "s>", "[", "INST]", "é🙂", "ok", " ", "/", "<\\s>", "assistant"]


def test_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "\\x", "a\nb", "<s>", "tool\\\n", "assistant\n"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        text, spans = op.render(turns)
        got, parsed, ends = op.parse(text)
        assert got == turns and parsed == spans and ends[-1] == len(text)
        assert [op.unescape(text[a:b]) if text[a:b] != t else t for (a, b), t in zip(spans, op.turns_under(turns))] == list(op.turns_under(turns))


def test_plain_turns_stay_plain():
    assert op.render([("user", "hi"), ("assistant", "yo\\")])[0] == "[INST]user\nhi[/INST]\n<s>assistant\nyo\\</s>\n"


def test_digests(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 50)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(9)), "long " * 30]), "x") for c in (1, 2, 3, None) for t in range(6)]
    rows += [(9, 0, "assistant", "same", "x")] * 3 + [(4, k, "assistant", f"turn {k}", "x") for k in range(500)] + [(5, 0, "user", "w " * 200000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in op.digests(op.format_conversations(op.with_probe(df))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for k, t, r, x, _ in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].loss_chars == len(op.PROBE) and got[-7].n_turns == 2
    assert [r.conv_id for r in op.digests(op.format_conversations(df.limit(0))).collect()] == []
