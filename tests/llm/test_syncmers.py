import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from leafmill.llm import syncmers as y
from leafmill.llm.queries import QUERIES


def slow_anchors(text, k=y.K, s=y.S):
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
    out = []
    for i in range(len(text) - k + 1):
        inner = [int(y._rolling(code(text[i + j : i + j + s]), s)[0]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_closed_syncmers(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdé 🙂\n") for _ in range(400))
    want = slow_anchors(text)
    assert y.anchors(text)[0].tolist() == want
    monkeypatch.setattr(y, "_BLOCK", 37)
    assert y.anchors(text)[0].tolist() == want
    # Context-free: an edit moves no anchor that it does not overlap.
    other = text[:200] + "#" + text[201:]
    clear = [i for i in want if i > 200 or i + y.K <= 200]
    assert set(clear) <= set(y.anchors(other)[0].tolist())


def test_short_and_equal():
    for t in ["", "a", "short text", "é" * 15, "x" * 16, "x" * 100_000]:
        x = y.sketch(y.anchors(t))
        assert y.likeness(x, y.sketch(y.anchors(t))) == 1.0 and (y.parse(y.fingerprint(x)) == x).all()
        assert y.covered(y.align(y.anchors(t), y.anchors(t), len(t))) >= len(t) - 2 * y.K * (len(t) > y.K)
    assert y.likeness(y.sketch(y.anchors("")), y.sketch(y.anchors("abc"))) == 0.0


MASK = (1 << 64) - 1


def slow_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def slow_hash(text):
    out = 0
    for ch in text:
        out = (out * 0x9E3779B97F4A7C15 + ord(ch)) & MASK
    return slow_mix(out)


def slow_sets(text):
    """Places and hashes of the closed syncmers, in whole numbers."""
    if len(text) < y.K:
        return [(0, slow_hash(text))] if text else []
    small = [slow_hash(text[i : i + y.S]) for i in range(len(text) - y.S + 1)]
    n = y.K - y.S + 1
    return [(i, slow_hash(text[i : i + y.K])) for i in range(len(text) - y.K + 1) if min(small[i : i + n]) in (small[i], small[i + n - 1])]


def slow_sketch(text):
    least = {}
    for _, h in slow_sets(text):
        least[h % 128] = min(h, least.get(h % 128, h))
    return [slow_mix(least[i]) % 0xFFFF + 1 if i in least else 0 for i in range(128)]


def slow_likeness(a, b):
    filled = [(x, z) for x, z in zip(a, b, strict=True) if x or z]
    return sum(x == z for x, z in filled) / len(filled) if filled else 1.0


def test_sketch_and_its_error():
    rng = random.Random(7)
    off = []
    for _ in range(60):
        a = "".join(rng.choice("abcdefgh é\n🙂") for _ in range(rng.choice([0, 5, 30, 600])))
        cut = rng.randint(0, len(a))
        b = a[:cut] + "".join(rng.choice("abcdefgh é") for _ in range(rng.choice([0, 9, 200])))
        for t in (a, b):
            assert y.anchors(t)[1].tolist() == [h for _, h in slow_sets(t)]
            assert y.sketch(y.anchors(t)).tolist() == slow_sketch(t)
        got = y.likeness(y.sketch(y.anchors(a)), y.sketch(y.anchors(b)))
        assert got == slow_likeness(slow_sketch(a), slow_sketch(b))
        s, t = ({h for _, h in slow_sets(x)} for x in (a, b))
        off.append(abs(got - (len(s & t) / len(s | t) if s | t else 1.0)))
    assert np.mean(off) < 0.03 and max(off) < 0.15


def test_alignment_against_brute_force():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(40):
        shared = [say(rng.randint(60, 300)) for _ in range(3)]
        a = "".join([say(rng.randint(0, 90)), shared[0], say(50), shared[1], say(9), shared[2]])
        b = "".join([shared[2], say(rng.randint(0, 200)), shared[0], say(30), shared[1]])
        found = y.align(y.anchors(a), y.anchors(b), len(a))
        for i, j, n in found:
            assert a[i : i + n] == b[j : j + n] and n >= y.K
        for part in shared:  # each is found but for what lies before its first and after its last anchor
            i, j = a.index(part), b.index(part)
            inside = [(s, e, n) for s, e, n in found if s < i + len(part) and s + n > i and e - s == j - i]
            assert sum(n for *_, n in inside) >= len(part) - 2 * y.K
        real = sum(any(a[p - o : p - o + y.K] in b for o in range(y.K) if 0 <= p - o <= len(a) - y.K) for p in range(len(a)))
        assert y.covered(found) <= real
    loop = "w " * 5000
    assert y.covered(y.align(y.anchors(loop), y.anchors("x" + loop), len(loop))) > 9900


def brute(docs):
    docs = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, u = t or "", u or ""
        n = len(t) // 2
        new = t[: len(t) - n] + u[:n]
        x, z, w = (slow_sketch(v) for v in (t, new, u))
        spelt = ["".join(f"{v:04x}" for v in part) for part in (x, z)]
        kept = [y.covered(y.align(y.anchors(t), y.anchors(v), len(t))) for v in (new, u)]
        assert kept[0] >= len(t) - n - 2 * y.K
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), *spelt, slow_likeness(x, z), slow_likeness(x, w), *kept)
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_query(spark, sf, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_syncmer_fingerprints"](spark, sf).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert got == brute(docs)
    near = [v[4] for v in got.values() if v[0] > 400]
    assert np.mean(near) > 0.25 and np.mean([v[5] for v in got.values()]) < 0.1


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, "x y", 0), (3, "p q", 1), (3, "p q", 1), (3, "r", 1), (9, "long " * 60_000, 2)],
        "doc_id long, text string, edge int",
    )
    got = y.edit_likeness(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "3", "9", "None"]
    assert next(r for r in got if r.doc_id == 2).edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert y.edit_likeness(df.limit(0)).count() == 0
    one = y.edit_likeness(df.where("doc_id = 9")).first()
    assert one.near_next == 1.0
