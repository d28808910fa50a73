import itertools
import random

import pyarrow.parquet as pq
import pytest
import xxhash

from leafmill.llm import simhash
from leafmill.llm.queries import QUERIES
from leafmill.scratch import Scratch


def slow_print(text):
    words, w = [], ""
    for ch in text or "":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += ch
    words += [w] if w else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids_prints):
    root = {i: i for i, _ in ids_prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(ids_prints, 2):
        if (x ^ y).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i, _ in ids_prints}


def test_fingerprint_matches_definition():
    for text in ["", "  \n", "One", "One two", "a b c", "A b C a B c a b c", "é Ü x y z\x1fq", "w " * 3000]:
        assert simhash.simhash(text.encode()) == slow_print(text)


def test_every_near_pair_meets_in_a_table():
    rng = random.Random(3)
    for level in (0, 1):
        table = simhash.masks(level)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for p in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << p
            assert any((x ^ y) & m == 0 for m in table)


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    prints = [(r["doc_id"], slow_print(r["text"])) for r in rows]
    want = groups(prints)
    assert len(got) == len(rows)
    for i, x in prints:
        assert got[i].fingerprint == f"{x:016x}"
        assert got[i].component_id == want[i]


@pytest.mark.parametrize("bucket", [4, 256])
def test_forest_in_deep_buckets(spark, bucket):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b for b in base}
    for b in base[:3]:  # long chains of near copies
        x = b
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    edges = simhash.link_forest(df, Scratch(spark, "t"), bucket=bucket).collect()
    ids = {simhash._signed(x): i for i, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = sorted((find(ids[e.a]), find(ids[e.b])))
        root[b] = a
    assert {i: find(i) for i in range(len(prints))} == groups(list(enumerate(prints)))


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, "", "y"), (None, "a b c d", None), (3, "a b c d", "z"), (3, "a b c d", "z"), (None, "q r s", "w")],
        "doc_id long, text string, fingerprint string",
    )
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("1", "1"), ("2", "1"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
