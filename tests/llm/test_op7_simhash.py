"""Fingerprints against a plain reading of the rule; components against all-pairs brute force."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import op7_simhash as op


def slow_fingerprint(text):
    words, cur = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, cur = (words + [cur] if cur else words), ""
        else:
            cur += c.lower() if "A" <= c <= "Z" else c
    words += [cur] if cur else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Least id reachable by links of at most 2 bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in (None, "", " \n\t", "one", "Two WORDS", "A b c d Ä x É\x0bend", "x " * 50, "the cat sat on the mat again and again"):
        assert op.fingerprint(t) == slow_fingerprint(t)


def test_replicas_cover_every_link():
    rng = random.Random(1)
    for _ in range(300):
        p = rng.getrandbits(64)
        q = p
        for b in rng.sample(range(64), rng.randint(0, 2)):
            q ^= 1 << b
        a, of, home = op.replicas(np.array([p, q], np.uint64))
        assert home.sum() == 2
        assert a[home & (of == 0)][0] in set(a[of == 1])
        assert a[home & (of == 1)][0] in set(a[of == 0])


def test_large_anchor_probes_like_comparison():
    rng = np.random.default_rng(2)
    centre = np.uint64(0x123456789ABCDEF0)
    fp = np.unique(centre ^ op.flips()[rng.permutation(2080)][:400] ^ np.roll(op.flips(), 7)[:400])
    big = np.unique(np.concatenate([fp, rng.integers(0, 2**63, 5000).astype(np.uint64)]))
    home = np.zeros(len(big), bool)
    home[np.isin(big, fp)] = True
    u, v = op.links(np.zeros(len(big), np.int64), big, home)
    got = {}

    def find(x):
        while got.get(x, x) != x:
            x = got[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        ra, rb = find(a), find(b)
        got[max(ra, rb)] = min(ra, rb)
    want = brute([int(x) for x in fp])
    assert [find(int(x)) for x in fp] == [int(fp[i]) for i in want]


def test_large_anchor_in_signed_order():
    """Rows come sorted as signed longs; the dense home group lies on both sides of bit 63."""
    rng = np.random.default_rng(4)
    centre = np.uint64(0x7FFFFFFFFFFFFFF0)
    group = np.unique(np.concatenate([centre ^ op.flips()[rng.permutation(2080)[:300]], centre ^ np.uint64(1 << 63) ^ op.flips()[rng.permutation(2080)[:300]]]))
    fp = np.unique(np.concatenate([group, rng.integers(0, 2**64, 5000, np.uint64)]).view(np.int64))  # signed order
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fp), np.int64)), pa.array(fp), pa.array(np.isin(fp.view(np.uint64), group))], ["anchor", "fp", "home"])
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for b in op.compare(iter([batch])):
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            root[max(a, c)] = min(a, c)
    members = np.sort(group.view(np.int64)).tolist()
    assert min(members) < 0 < max(members)
    assert [find(x) for x in members] == [members[i] for i in brute([x % 2**64 for x in members])]


def test_components(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(120)) for _ in range(12)]
    rows, i = [], 0
    for t in base:
        for _ in range(12):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((i, " ".join(w), 1))
            i += 1
    rows += [(i, None, 1), (i + 1, "", 1), (i + 2, "  ", 1), (i + 3, "one", 1), (i + 3, "one", 1), (i + 4, "word " * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op.near_dedup(df).collect())
    fps = [slow_fingerprint(t) if len(t or "") < 99999 else op.fingerprint(t) for _, t, _ in rows]
    want = sorted((rows[k][0], f"{fps[k]:016x}", rows[r][0]) for k, r in enumerate(brute(fps)))
    assert got == want
    assert len({g[2] for g in got}) < len(rows) - 20
    assert op.near_dedup(df.limit(0)).collect() == []


def test_large_anchors_are_split(spark):
    """Dense clusters of fingerprints: with anchors over 16 members split, the components are the same."""
    rng = random.Random(9)
    fps = []
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = brute(fps)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(fps[i])
    for split in (16, 1 << 20):
        got = {}
        for r in op.components(op.near_links(df, split)).collect():
            got.setdefault(r.root, set()).add(r.u % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_text_ids_keep_their_type(spark):
    rows = [("b", "some text of a few words"), ("a", "some text of a few words"), (None, "")]
    got = {r.doc_id: r.component_id for r in op.near_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", None: None}
