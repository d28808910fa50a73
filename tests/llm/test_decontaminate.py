import hashlib
import random
import re

import pytest
from oracle import same

from leafmill.llm import decontaminate as d
from leafmill.llm.queries import ORACLES, QUERIES


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, names = set(), set()
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add("null" if k is None else str(k))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_pass", [d.PHRASES_PER_PASS, 7])
def test_against_brute_force(spark, per_pass):
    rng = random.Random(1)
    vocab = ["the", "of", "Été", "x1", "a", "b", "zz"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(20)), (2, say(3)), (10, say(14)), (3, ""), (4, None), (None, "q q q"), (5, "the of"), (5, say(13))]
    docs = [(i, " ".join([say(9), items[i % 8][1] or "", say(i * 3)])) for i in range(24)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (7, "THE-OF"), (7, "THE-OF"), (8, "the.of " * 900)]
    a = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(a, b, per_pass=per_pass)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)
    assert d.contamination(a.limit(0), b).count() == 0
    none = d.contamination(a, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_items for r in none)


def test_proximity(spark):
    a = spark.createDataFrame([(1, "red x x blue"), (2, "blue red"), (3, "red x x x blue"), (4, "red")], "doc_id long, text string")
    index = d.build_index(a)
    rows = [r for part in d.search(index, {(b"red", b"blue"): {"q"}}, slop=3) for r in part.collect()]
    assert {r.id for r in rows if r["items"]} == {1, 2}


@pytest.mark.parametrize("slop", [0, 2, 80, 10_000])
def test_proximity_against_brute_force(spark, slop):
    rng = random.Random(slop)
    docs = [(i, " ".join(rng.choice(["red", "blue", "green", *"abcdefghij"]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    docs += [(200, "x red end"), (201, "blue start"), (202, ""), (203, "green " + "y " * 90 + "red blue")]
    asked = {(b"red", b"blue"): {"two"}, (b"green", b"red", b"blue"): {"three"}}
    index = d.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    often = d.frequencies(index, {w for p in asked for w in p})
    got = {r.id: (sorted(r.starts), set(r["items"])) for part in d.search(index, asked, slop) for r in part.collect()}
    want = {}
    for i, t in docs:
        w = [x.encode() for x in words(t)]
        for terms, names in asked.items():
            rare = min(range(len(terms)), key=lambda k: (often[terms[k]], k))
            for at, x in enumerate(w):
                if x == terms[rare] and all(y in w[max(0, at - slop) : at + slop + 1] for y in terms):
                    starts, found = want.setdefault(i, ([], set()))
                    starts.append(at)
                    found |= names
    assert got == {i: (sorted(s), n) for i, (s, n) in want.items()}


def test_query(spark, sf):
    same(QUERIES["op5_benchmark_decontamination"](spark, sf), ORACLES["op5_benchmark_decontamination"], sf)
