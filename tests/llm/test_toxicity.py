import math
import random
import zlib

import numpy as np

from leafmill.llm import toxicity as x
from leafmill.llm.queries import QUERIES


def slow_segments(s):
    """Maximal segments by their recursive definition: the best of all
    segments (the shortest, then leftmost), then the same on either side."""
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            v = sum(s[i:j])
            if v > 1e-9 and (best is None or (v, -(j - i)) > (best[2] + 1e-9, 0) or abs(v - best[2]) < 1e-9 and j - i < best[1] - best[0]):
                best = (i, j, v)
    if best is None:
        return []
    i, j, v = best
    return slow_segments(s[:i]) + [best] + [(a + j, b + j, w) for a, b, w in slow_segments(s[j:])]


def test_segments():
    assert x.maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3.0, -1.3, -0.7, 1.1, 2.45]) + rng.random() / 97 for _ in range(rng.randint(0, 14))]
        got = x.maximal_segments(np.array(s))
        want = slow_segments(s)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_decay_is_the_positive_root():
    s, p = np.array([2.0, -1.0]), np.array([0.2, 0.8])
    at = x._decay(s, p)
    assert abs((p * np.exp(at * s)).sum() - 1) < 1e-6


def plain_model(sample):
    """The model by plain loops, from (y, part, text)."""
    sets = [(y, part, set((t or "").lower().split())) for y, part, t in sample]
    total = {}
    for *_, words in sets:
        for w in words:
            total[w] = total.get(w, 0) + 1
    kinds = sorted(w for w, n in total.items() if n > 1)

    def fit(parts):
        n = {w: [sum(w in words for y, p, words in sets if y == k and p in parts) for k in (0, 1)] for w in kinds}
        all_ = [sum(v[k] for v in n.values()) for k in (0, 1)]
        whole = sum(all_)
        scores, shares = {}, {}
        for w, both in n.items():
            a = 1 + x.PRIOR * sum(both) / whole
            with_prior = [both[k] + a * (all_[k] + 1) / (whole + 2) for k in (0, 1)]
            rest = [max(1, all_[k] + (len(kinds) + x.PRIOR) * (all_[k] + 1) / (whole + 2) - with_prior[k]) for k in (0, 1)]
            odds = math.log(with_prior[1] / rest[1]) - math.log(with_prior[0] / rest[0])
            sure = abs(odds) - x.ERRORS * math.sqrt(sum(1 / v for v in with_prior))
            scores[w] = math.copysign(sure, odds) - x.DRIFT if sure > 0 and sum(both) else -x.DRIFT
            shares[w] = both[0] + x.PRIOR * sum(both) / whole
        size = sum(shares.values())
        low, high = 1e-3, 5.0  # the root of a convex function that is negative just above 0
        for _ in range(200):
            mid = (low + high) / 2
            if sum(shares[w] / size * math.exp(mid * scores[w]) for w in kinds) <= 1:
                low = mid
            else:
                high = mid
        return scores, high

    def segments(model, text):
        words = (text or "").lower().split()
        return len(words), slow_segments([model[0].get(w, -x.DRIFT) for w in words])

    def evidence(model, scale, n, found):
        surprise = [model[1] * s - math.log(scale * max(1, n)) for *_, s in found]
        best = min(40, max(-5, max(surprise, default=-5)))
        return [best, math.log1p(sum(v for v in surprise if v > -math.log(x.SIGNIFICANT))), math.log1p(n) / 5]

    half, full = fit([0]), fit([0, 1])
    seen = [(y, *segments(half, t)) for y, p, t in sample if p == 1]
    clean = [half[1] * max((s for *_, s in f), default=0.0) - math.log(max(1, n)) for y, n, f in seen if y == 0]
    scale = min(1.0, max(1e-6, math.exp(sum(clean) / len(clean) - 0.5772)))
    rows = [(y, evidence(half, scale, n, f)) for y, n, f in seen]

    def loss(w):
        z = [sum(a * b for a, b in zip(w, [*e, 1.0])) for _, e in rows]
        return sum(math.log1p(math.exp(-v if y else v)) for (y, _), v in zip(rows, z)) + sum(v * v for v in w[:3]) / 2 + 5e-4 * w[3] ** 2

    w, step = [0.0] * 4, 1.0  # coordinate descent by trial
    while step > 1e-7:
        moved = False
        for i in range(4):
            for d in (step, -step):
                then = [v + d * (k == i) for k, v in enumerate(w)]
                if loss(then) < loss(w):
                    w, moved = then, True
        step = step if moved else step / 2
    toxic = sum(y for y, *_ in sample)
    drawn = (sum(y for y, _ in rows) + 1) / (len(rows) + 2)
    real = (toxic + 1) / (len(sample) + 2)
    w[3] += math.log(real / (1 - real)) - math.log(drawn / (1 - drawn))
    return lambda t: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*evidence(full, scale, *segments(full, t)), 1.0]))))


def test_scores_against_plain_loops(spark):
    rng = random.Random(11)
    kinds, bad = [f"w{i}" for i in range(40)], ["vile", "nasty", "awful"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(kinds) for _ in range(rng.randint(3, 14))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(rng.randint(1, 3))]
        elif i % 9 == 0:
            words[0] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in x.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    parts = {r.doc_id: r.part for r in df.selectExpr("doc_id", "int(pmod(xxhash64(text), 3) = 0) AS part").collect()}
    learnt = [(y, parts[i], rows[i][1]) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    want = plain_model(learnt)
    for i, t in rows:
        assert abs(got[i] - want(t)) < 1e-4, (i, t, got[i], want(t))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op6_toxic_segments"](spark, sf).collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(r.predicted, y) for r, y in labels if r.held_out]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / len(held)
    assert caught > 0.85 and wrong < 0.01


def test_passages_and_odd_rows(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 6 == 0:
            words[20:24] = ["vile", "nasty", "vile", "awful"]
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(i % 6 == 0)))
    rows += [(None, "vile nasty", 0), (1000, None, 0), (1001, "", 0), (1, rows[1][1], 0), (1002, "w1 " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (None, 1), (2, None), (3, 5), (1, 0)], "doc_id long, toxic int")
    got = x.score(df, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == int(r.doc_id % 6 == 0)
            if r.predicted:
                assert [(p.start, p.end) for p in r.passages] == [(20, 24)]
    assert next(r for r in got if r.doc_id == 1001).predicted == 0
    assert x.score(df.limit(0), lab).count() == 0
    flat = x.score(df, lab.limit(0)).collect()
    assert {r.score for r in flat} == {0.5}
