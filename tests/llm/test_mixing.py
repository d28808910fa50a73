from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import mixing as m
from leafmill.llm.queries import QUERIES


def test_targets():
    assert m.targets([100, 100], [3, 1]) == [200.0, 100.0]  # 225 is cut to 200
    assert m.targets([10, 90, 0], [3, 1, 2]) == [20.0, 130.0, 0.0]
    assert m.targets([], []) == [] and m.targets([0, 0], [3, 1]) == [0.0, 0.0]


def test_tree_keeps_quotas():
    for shards in (1, 7, 64):
        t = m.split_tree([5, 1000, 0, 333], shards, np.random.default_rng(0))
        assert t.sum(axis=0).tolist() == [5, 1000, 0, 333]
        assert t.sum(axis=1).max() - t.sum(axis=1).min() <= 2


def near(rows):
    words, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        words[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"]) and len(r.shards) <= 2
        assert r.size == 0 or r.taken == len(r.shards) * r["size"]
    for s in words:
        assert abs(words[s] - target[s]) <= max(1, most[s] / 2 + 1), (s, words[s], target[s])


def test_query(spark, sf):
    rows = QUERIES["op8_source_mixing"](spark, sf).collect()
    near(rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, QUERIES["op8_source_mixing"](spark, sf).collect()))


def test_large_blocks_are_opened(spark, monkeypatch):
    monkeypatch.setattr(m, "HISTOGRAM", 32)
    monkeypatch.setattr(m, "OPEN_ROWS", 8)
    df = spark.range(3000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text",
        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 2) end as source", "1 as size", "'x' as draws",
    )
    rows = m.mix(df).collect()
    assert len(rows) == 3000
    near(rows)


def plain_mix(rows, weights, seed, shards):
    """The same draws by plain loops over (source, size, key), key unsigned:
    how often and where each row goes, in order of shards."""
    names = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    own = [sorted((k, n) for s, n, k in rows if s == name) for name in names]
    sizes = [sum(n for _, n in o) for o in own]
    goal = m.targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    rng = np.random.default_rng(seed)
    bits, orders = [], []
    for o, size in zip(own, sizes):
        most = min(m.HISTOGRAM * size / max(1, sum(sizes)), len(o) / m.BLOCK_ROWS)
        b = 0
        while 2 ** (b + 1) <= most:
            b += 1
        bits.append(b)
    for b, size, t in zip(bits, sizes, goal):
        orders.append([rng.permutation(2**b) for _ in range((int(t // size) if size else 0) + 1)])
    urns = []
    for o, b, size, t, order in zip(own, bits, sizes, goal, orders):
        urn = [(turn, [k for k, _ in o if k >> 64 - b == block]) for turn, whole in enumerate(order[:-1]) for block in whole]
        left, turn = t - (len(order) - 1) * size, len(order) - 1
        for block in order[-1]:
            inside = [(k, n) for k, n in o if k >> 64 - b == block]
            if sum(n for _, n in inside) <= left:
                urn.append((turn, [k for k, _ in inside]))
                left -= sum(n for _, n in inside)
                continue
            if left > 0:  # opened: whole parts of finer bits go first, in order
                done, taken = b, []
                while len(inside) > m.OPEN_ROWS and done < 64:
                    step = min(12, 64 - done, max(1, int(np.log2(m.HISTOGRAM))))
                    done += step
                    for part in sorted({k >> 64 - done for k, _ in inside}):
                        these = [(k, n) for k, n in inside if k >> 64 - done == part]
                        if sum(n for _, n in these) > left:
                            inside = these
                            break
                        taken += [k for k, _ in these]
                        left -= sum(n for _, n in these)
                urn.append((turn, taken + m._fit(inside, left)))
            break
        urns.append(urn)
    quotas = m.split_tree([len(u) for u in urns], shards, rng)
    out = {}
    for i, urn in enumerate(urns):
        mixed, at = rng.permutation(len(urn)), 0
        for shard in range(shards):
            for j in mixed[at : at + quotas[shard, i]]:
                turn, keys = urn[j]
                for k in keys:
                    out.setdefault((names[i], k), []).append((turn, shard))
            at += quotas[shard, i]
    return {k: [s for _, s in sorted(v)] for k, v in out.items()}


def test_draws_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(m, "OPEN_ROWS", 6)
    monkeypatch.setattr(m, "BLOCK_ROWS", 16)
    df = spark.range(900).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 11 as int)) as text",
        "case when id % 10 = 3 then null when id % 3 = 0 then 'b' when id % 7 = 1 then 'small' else 'a' end as source",
    )
    keyed = {r.id: r for r in m._keyed(df, "doc_id", "text", "source", 5).collect()}
    want = plain_mix([(r.source, r["size"], r.key & (1 << 64) - 1) for r in keyed.values()], m.WEIGHTS, 5, 9)
    assert len({len(v) for v in want.values()}) == 2
    for r in m.mix(df, seed=5, shards=9).collect():
        assert r.shards == want.get((r.source, keyed[r.doc_id].key & (1 << 64) - 1), [])


def test_one_source_of_repeated_rows_and_odd_names(spark):
    df = spark.createDataFrame([(i % 3, "w " * (1 + i % 3), "only", 7) for i in range(30)], "`a.id` long, text string, `a.source` string, n int")
    rows = m.mix(df, "a.id", "text", "a.source").collect()
    assert len(rows) == 30 and len({(r["a.id"], r.taken) for r in rows}) == 3  # copies go together
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 30
    assert m.mixed_rows(df, "a.id", "text", "a.source").columns == df.columns


def test_more_sources_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "HISTOGRAM", 8)
    df = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "concat('s', id % 40) as source")
    near(m.mix(df).collect())


def test_shards_are_partitions(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_WORDS", 100)
    df = spark.range(300).selectExpr("id as doc_id", "'a b c' as text", "concat('s', id % 2) as source")
    shards = {r.doc_id: r.shards for r in m.mix(df).collect()}
    parts = m.mixed_rows(df).withColumn("p", F.spark_partition_id()).collect()
    assert max(s for v in shards.values() for s in v) == 13  # 1350 words, 100 in each
    assert sorted((r.doc_id, r.p) for r in parts) == sorted((i, s) for i, v in shards.items() for s in v)


def test_odd_rows_and_mixed_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "a", 0), (2, "", "a", 0), (None, "x y", None, 0), (3, "p q r", "b", 1), (3, "p q r", "b", 1), (4, "z " * 5000, "a", 2)],
        "doc_id long, text string, source string, draw int",
    )
    rows = m.mix(df).collect()
    assert len(rows) == 6 and {r["size"] for r in rows if r.doc_id in (1, 2)} == {0}
    out = m.mixed_rows(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(n.get(r.doc_id, 0) == len(r.shards) for r in rows if r.doc_id not in (3,))
    assert m.mix(df.limit(0)).count() == 0 and m.mixed_rows(df.limit(0)).count() == 0
