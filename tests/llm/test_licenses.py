import math
import random
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import same

from leafmill import scratch
from leafmill.llm import licenses as lic
from leafmill.llm.queries import ORACLES, QUERIES


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op2_license_scan"](spark, sf)
    same(df, ORACLES["op2_license_scan"], sf)
    got = df.collect()
    assert any(r.inherited_from for r in got) and any(r.own_license == "MIT" for r in got)


def test_against_sql_without_the_gate(spark, tmp_path):
    """Files put together from pieces of licenses, comments, code and odd text."""
    rng = random.Random(3)
    words = [w for _, t in lic.TEMPLATES for w in t.split()]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(250):
        bits = []
        for _ in range(rng.randint(0, 5)):
            text = rng.choice(lic.TEMPLATES)[1]
            kept = " ".join(w for w in text.split() if rng.random() < rng.choice([1, 0.9, 0.75, 0.6]))
            wide = rng.choice([4, 9, 10_000])
            lines = [" ".join(kept.split()[k : k + wide]) for k in range(0, len(kept.split()), wide)]
            mark = rng.choice(["", "", "# ", "// ", " * ", "-- ", "%"])
            block = "\n".join(mark + x for x in lines)
            bits.append(rng.choice([block, f"/*\n{block}\n*/", f"<!-- {block} -->", say(7), f"int a = {i};", "été ÉCRIT 1.2.3. \x01", say(40)]))
        text = rng.choice(["\n", "\n\n", "\n#\n", " ", "\r\n \n"]).join(bits)
        rows.append((i, text if i % 40 else None, rng.choice(["", "a", "a/b", "c"])))
    rows += [(300, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause x", "s"), (300, "# SPDX-License-Identifier: ISC\n", "s"), (301, "", None)]
    table = pa.table(dict(zip(["doc_id", "text", "source"], map(list, zip(*rows, strict=True)), strict=True)))
    pq.write_table(table, tmp_path / "documents.parquet")
    path = "source || '/f' || doc_id % 7 || CASE WHEN doc_id % 9 = 0 THEN '/LICENSE.' ELSE '/x.' END || doc_id"
    df = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("*", f"{path} AS path")
    got = lic.scan(df)
    same(got, lic.oracle(path), tmp_path)
    kinds = Counter(r.own_license for r in got.collect())
    assert len(kinds) > 15 and kinds[None] > 20


def test_few_files_and_partitions(spark, tmp_path):
    """However many pieces the input has and shuffles deal, each scratch table
    has a file for each core at most, and the result a partition."""
    said = [f"Licensed under {t}\ntale {i}" if i % 3 else f"tale {i}" for i, (_, t) in enumerate(lic.TEMPLATES * 3)]
    (tmp_path / "docs").mkdir()
    for k in range(12):
        rows = {"doc_id": list(range(k, len(said), 12)), "text": said[k::12], "source": [f"s{i % 5}" for i in range(k, len(said), 12)]}
        pq.write_table(pa.table(rows), tmp_path / f"docs/{k}.parquet")
    pq.write_table(pq.read_table(tmp_path / "docs"), tmp_path / "documents.parquet")
    path = "source || '/d' || doc_id % 40 || '/LICENSE.' || doc_id"
    many = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64m"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = lic.scan(spark.read.parquet(str(tmp_path / "docs")).selectExpr("*", f"{path} AS path"))
        same(got, lic.oracle(path), tmp_path)
        most = spark.sparkContext.defaultParallelism
        assert got.rdd.getNumPartitions() <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = Counter(p.parent.name for p in Path(scratch._open[-1].root.removeprefix("file:")).glob("*/part-*"))
    assert set(files) == {"parts", "distinct", "kinds", "dirs", "declared"} and max(files.values()) <= most, files


def test_templates_without_python_workers(spark):
    vectors = lic.Vectors({w: 1 for w in lic.vocabulary()}, 9)
    plan = lic.classify(spark.range(9).selectExpr("id", "'mit license' AS said"), vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") >= 2 and "LogicalRDD" not in plan


def slow_cosine(said, vectors):
    c = Counter(lic.tokens_of(said))
    w = {t: (1 + math.log(k)) * vectors.idf.get(t, vectors.other) for t, k in c.items()}
    size = math.sqrt(sum(x * x for x in w.values()))
    dots = Counter()
    for n, name, t, x in vectors.rows:
        dots[n, name] += w.get(t, 0) * x
    best = max(((round(v / size, 6), name) for (_, name), v in dots.items()), default=(0, "")) if size else (0, "")
    return best if best[0] >= vectors.threshold else None


def test_any_of():
    rng = random.Random(4)
    for _ in range(200):
        words = {"".join(rng.choice("ab.2") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        pattern = re.compile(lic.any_of(sorted(words)))
        for _ in range(40):
            w = "".join(rng.choice("ab.2") for _ in range(rng.randint(0, 5)))
            assert bool(pattern.fullmatch(w)) == (w in words), (words, w)


def test_cosine_gate_and_bound_against_brute_force(spark):
    rng = random.Random(1)
    vocab = lic.vocabulary()
    vectors = lic.Vectors({w: rng.choice([1, 2, 30, 900]) for w in vocab}, 1000)
    said = {t.lower() for _, t in lic.TEMPLATES} | {"licensed licensed licensed", "license: ???", "license", "", "all rights all rights", "mit"}
    for _ in range(600):
        kept = [w for w in rng.choice(lic.TEMPLATES)[1].lower().split() if rng.random() < rng.random() + 0.3]
        said.add(" ".join(kept + [rng.choice(["foo", "bar", "license", "the", f"x{rng.random()}"]) for _ in range(rng.randint(0, 9))]))
    df = spark.createDataFrame([(s,) for s in sorted(said)], "said string")
    passed = df.where(df.said.rlike(vectors.gate_pattern()) & vectors.may_reach(df.said))
    got = {r.k: (r.license, r.score) for r in lic.classify(passed.selectExpr("said as k", "said"), vectors).collect()}
    assert passed.count() < len(said)
    for s in said:
        want = slow_cosine(s, vectors)
        assert (s in got) == (want is not None), s
        if want:
            assert abs(got[s][1] - want[0]) < 2e-6 and got[s][0] == want[1]


def test_nearest_ancestor_and_odd_rows(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "LICENSE", f"x\n{mit}"), (2, "a/b/c.py", "code"), (3, "a/COPYING", f"about\n{apache}"), (4, "a/b/d/e.py", None),
        (5, "ab/x.py", ""), (6, "a/b/own.py", f"def f(x):\n  return g(x) + h(x, y, z) * 7\n{mit} end"), (7, None, mit), (None, "a/z", "q"), (8, "top.py", "q"), (8, "top.py", "q"),
        (9, "//a//b", "license " * 20_000), (10, "", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 as row", "2 as score")
    got = {(r.doc_id, r.path): r for r in lic.scan(df).collect()}
    say = lambda k: (got[k].license, got[k].inherited_from)
    assert say((2, "a/b/c.py")) == ("Apache-2.0", "a") and say((4, "a/b/d/e.py")) == ("Apache-2.0", "a")
    assert say((5, "ab/x.py")) == ("MIT", "") and say((None, "a/z")) == ("Apache-2.0", "a")
    assert say((6, "a/b/own.py")) == ("MIT", None) and say((7, None)) == ("MIT", None) and say((8, "top.py")) == ("MIT", "")
    assert lic.scan(df).count() == len(rows) and lic.scan(df.limit(0)).count() == 0
    none = lic.scan(df.where("doc_id = 8"))
    assert [r.license for r in none.collect()] == [None, None]


def test_usual_files_and_headers(spark):
    """What files of projects look like; nine of ten and more are named."""
    wrap = lambda text, lead="": "\n".join(lead + " ".join(text.split()[i : i + 11]) for i in range(0, len(text.split()), 11))
    body = lambda name, start: next(t for k, t in reversed(lic.TEMPLATES) if k == name and t.startswith(start))
    years = "Copyright (c) 2020 A. Person\n\n"
    mit, bsd = body("MIT", "Permission"), lambda n: body(f"BSD-{n}-Clause", "Redist")
    gnu = lambda name, start="This": body(name, start)
    code = "\nimport os\n" + "code here = 1\n" * 300
    cases = [
        (f"MIT License\n\n{years}{wrap(mit)}", "MIT"), (years + wrap(mit), "MIT"), ("MIT License\n\nCopyright 2019 Someone", "MIT"),
        ("The MIT License (MIT)\n\nand more", "MIT"), (wrap(mit, "// ") + code, "MIT"),
        (years + wrap(bsd(3)), "BSD-3-Clause"), (years + wrap(bsd(2)), "BSD-2-Clause"), (f"/*\n{years}{wrap(bsd(3), ' * ')}\n */{code}", "BSD-3-Clause"),
        ("   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nPreamble " + "of other words " * 9000, "GPL-3.0"),
        (wrap(gnu("GPL-3.0"), "# ") + code, "GPL-3.0"), (wrap(gnu("GPL-2.0"), "# ") + code, "GPL-2.0"), ("int a;\n/*\n" + wrap(gnu("GPL-2.0")) + "\n*/" + code, "GPL-2.0"),
        ("/*\n" + wrap(gnu("LGPL-2.1", "This library"), " * ") + "\n */" + code, "LGPL-2.1"), (wrap(gnu("AGPL-3.0"), "-- ") + code, "AGPL-3.0"),
        ("# Copyright 2021 A Company\n#\n" + wrap(body("Apache-2.0", "Licensed"), "# ") + code, "Apache-2.0"),
        ("Apache License\nVersion 2.0, January 2004\n\n" + "of other words " * 900 + "\n\n" + wrap(body("Apache-2.0", "2. Grant")) + "\n\n" + "more " * 90, "Apache-2.0"),
        ("<!-- " + wrap(body("MPL-2.0", "This Source")) + " -->" + code, "MPL-2.0"), ("/* " + wrap(body("MPL-2.0", "This Source"), " * ") + " */" + code, "MPL-2.0"),
        (years + wrap(body("ISC", "Permission")), "ISC"), (wrap(body("Zlib", "This")), "Zlib"), (wrap(body("Unlicense", "This")) + "\n\n" + wrap(body("Unlicense", "Anyone")), "Unlicense"),
        (body("BSL-1.0", "Boost") + "\n\n" + wrap(body("BSL-1.0", "Permission")), "BSL-1.0"), (wrap(body("EPL-2.0", "This program"), " * ") + code, "EPL-2.0"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "MIT OR Apache-2.0"), ("// SPDX-License-Identifier: EUPL-1.2", "EUPL-1.2"),
        ("# SPDX-License-Identifier: ISC\n", "ISC"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("A story. This work is licensed under a Creative Commons Attribution 4.0 International License. The end of it " + "goes on " * 50, "CC-BY-4.0"),
    ]
    clean = ["the license of a driver was lost and hereby we redistribute the news\n" * 40, "free software is a matter of liberty " * 30, "Permission denied"]
    rows = [(i, f"d{i}/x", t) for i, (t, _) in enumerate(cases)] + [(100 + i, f"c{i}/x", t) for i, t in enumerate(clean)]
    got = {r.doc_id: r.own_license for r in lic.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    missed = [(t[:40], want, got[i]) for i, (t, want) in enumerate(cases) if got[i] != want]
    assert len(missed) <= len(cases) // 10, missed
    assert not any(got[100 + i] for i in range(len(clean)))
    header = lic.scan(spark.createDataFrame([(1, "a/x.py", cases[9][0]), (2, "a/y.py", "z"), (3, "b/COPYING", cases[8][0]), (4, "b/c/y", "z")], "doc_id long, path string, text string"))
    assert {r.doc_id: r.license for r in header.collect()} == {1: "GPL-3.0", 2: None, 3: "GPL-3.0", 4: "GPL-3.0"}
