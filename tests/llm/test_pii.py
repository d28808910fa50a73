import hashlib
import random
import re

import pyarrow.parquet as pq

from leafmill.llm import pii
from leafmill.llm.queries import QUERIES, pii_digest

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def same(rows, docs):
    by = {r.doc_id: r for r in rows}
    for i, t in docs:
        want, r = brute(t), by[i]
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (i, said, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in PLAIN]
        assert {x for x in said.split(",") if x} <= set(r.spans.split(","))


def test_query(spark, sf):
    rows = QUERIES["op3_pii_candidates"](spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert len(rows) == len(docs)
    same(rows, docs)


def test_patterns_against_plain_ones(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "-", "+", "1", "22", "333", "4444", " ", "  ", "a.b@c-d.ef", "255", "256", "x", "é🙂", "(", ")", "\n", "4111 1111-1111 1111", "+1 (202) 555-0100", "10.0.0.1", "\x01", "_", "%"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(700)]
    docs += [
        (900, "a@b.c@d.e"), (901, "a@b.c_d@e.f"), (902, "1.2.3.4.5.6.7.8"), (903, "007.0255.1.1 0000.0.0.0"), (904, None), (905, ""),
        (906, "a" * 60_000), (907, "7" * 60_000), (908, "1 " * 60_000), (909, "x@" + "a." * 30_000 + "b"), (910, "+1" + "-(" * 30_000 + "5"),
        (911, "a@b.c " * 3000), (912, "9" * 400 + ".1.1.1"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as found")
    same(pii_digest(df).collect(), docs)


def test_added_spans_and_redaction(spark):
    rows = [(i, f"write to joe{i}@mail.org or call +1 (202) 555-01{i:02d} now, host 10.0.{i}.1 ok") for i in range(60)]
    rows += [(100 + i, f"bad 999.{i}.1.1 and 1234 5678 9012 34{i:02d} here") for i in range(40)]
    rows += [(200, "api_key = 'abcdefgh12345678ZZ' end"), (201, "mail: joe [at] site [dot] org."), (202, "tel 202-555-0199")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    for r in found.values():
        spans = sorted((s.start, s.end) for s in [*r.base, *r.added] if s in r.added or True)
        added = [(s.start, s.end) for s in r.added]
        for a, b in added:
            assert all(e <= a or s >= b for s, e in spans if (s, e) != (a, b))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[5] == "write to [email] or call [phone] now, host [ip] ok"


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a@b.cd", 1), (1, None, 1), (1, None, 1), (2, "", 1)], "doc_id long, text string, gen int")
    got = pii_digest(df).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", ""), ("1", ""), ("2", ""), ("None", "email:0:6")]
    assert pii_digest(df.limit(0)).count() == 0


def test_trees_learn():
    rows = [((g, d, 0, 0, c, 0, 0), float(10 * (c == 2 and d > 3)), 10.0 - 10 * (c == 2 and d > 3)) for g in range(3) for d in range(8) for c in range(3)]
    trees = pii.Trees().fit(rows)
    assert all((trees.margin(x) > 0) == (p > n) for x, p, n in rows)


def test_planted_secrets_spelt_mails_and_local_phones(spark):
    rng = random.Random(5)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        plain = f"page {rng.randint(10, 99)} of 12 34, {rng.randint(100, 999)} parts; token = get_token_from_text and key: {'x' * 20} end"
        hit = [f'token = "{code(40)}', f"joe{i} [at] site [dot] org", f"(202) 555-0{100 + i}", None][i % 4]
        rows.append((i, f"{plain} so {hit} end" if hit else plain))
        if hit:
            at = rows[-1][1].index(hit)
            want[i] = (("secret", "email", "phone")[i % 4], at, at + len(hit))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (df, df.where("doc_id < 3")):  # many examples, and too few to learn from
        for r in pii.find(docs).collect():
            assert [(s.name, s.start, s.end) for s in r.added] == ([want[r.doc_id]] if r.doc_id in want else []), r


def test_recall_of_planted_data_under_any_layout(spark):
    """Of every wider kind nine of ten and more are found, whole, and next to
    nothing else; rows dealt in another way give the same spans."""
    rng = random.Random(15)
    words = "the page of a story with numbers 12 and 2019 goes on to line 3.4 at noon::then std::vector 1:2:3 of 10-20-30 items".split()
    hexa = "0123456789abcdef"

    def card():
        d = [rng.randrange(10) for _ in range(15)]
        d += [x for x in range(10) if luhn("".join(map(str, [*d, x])))]
        text = "".join(map(str, d))
        return ".".join(text[i : i + 4] for i in range(0, 16, 4))

    group = lambda: f"{rng.randrange(1, 1 << 16):x}"
    make = {
        "email": lambda: f"{rng.choice(['joe', 'ann.b', 'x_y'])}{rng.randrange(99)} [at] {rng.choice(['site', 'mail-2'])} [dot] {rng.choice(['org', 'com'])}",
        "phone": lambda: rng.choice(["({}) 555-{}", "{}-555-{}", "00{} 555 {}"]).format(rng.randrange(210, 980), rng.randrange(1000, 9999)),
        "card": card,
        "ip": lambda: rng.choice([":".join([*(group() for _ in range(7)), "a1"]), f"2001:db8::{group()}:{group()}", f"fe80::1:{group()}"]),
        "secret": lambda: rng.choice(["token = '", "api_key: ", "password="]) + "".join(rng.choice(hexa) for _ in range(rng.choice([24, 40, 400]))),
    }
    rows, want = [], {}
    for i in range(600):
        kind = rng.choice([None, *make])
        lead = " ".join(rng.choice(words) for _ in range(rng.randint(3, 20)))
        hit = make[kind]() if kind else "the"
        rows.append((i, f"{lead} so {hit} " + " ".join(rng.choice(words) for _ in range(5))))
        if kind:
            want[i] = (kind, len(lead) + 4, len(lead) + 4 + len(hit))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: [(s.name, s.start, s.end) for s in r.added] for r in pii.find(df.repartition(n, "text")).collect()} for n in (1, 7)]
    assert got[0] == got[1]
    for kind in make:
        mine = [i for i, w in want.items() if w[0] == kind]
        assert sum(want[i] in got[0][i] for i in mine) >= 0.9 * len(mine), kind
    other = sum(len([x for x in found if x != want.get(i)]) for i, found in got[0].items())
    assert other <= 0.05 * len(want)


def test_redaction_of_repeated_and_null_rows(spark):
    rows = [(1, "a@b.cd x"), (1, "a@b.cd x"), (1, "y"), (None, "z 1.2.3.4"), (2, None)]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, "[email] x"), (1, "[email] x"), (1, "y"), (None, "z [ip]"), (2, "")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_wider_checks(spark):
    cases = [
        (9, "token = 0a1b2c3d4e5f6a7b", 0, True), (9, "token = get_token_from_env", 0, False), (9, "key: xxxxxxxxxxxxxxxx", 0, False),
        (4, "a [at] b [dot] org", 0, True), (4, "look (at) me. Then", 0, False), (7, "4111.1111.1111.1111", 0, True), (7, "4111.1111.1111.1112", 0, False),
        (8, "(202) 555-0143", 0, True), (8, "202-555-0143", 0, True), (8, "111-111-1111", 0, None), (8, "111-111-1111", 2, True), (8, "111-111-1111", 3, False),
        (5, "root@host", 1, True), (5, "root@host", 0, None), (5, "1@2", 1, False), (6, "2001:db8:0:0:0:0:0:1", 0, True), (6, "00:11:22:33:44:55:66:77", 0, False),
        (6, "2001:db8::1", 0, True), (6, "::1", 0, False), (6, "::", 0, False), (6, "dead::beef", 0, False),
    ]
    df = spark.createDataFrame(cases, "gen int, hit string, context int, want boolean")
    for r in df.withColumn("got", pii._check(df.gen, df.hit, df.context)).collect():
        assert r.got == r.want, r
    assert pii._cuts([]) == pii._cuts([(1.0, 0.0, 9.0)]) == (-float("inf"), float("inf"))
    assert pii._cuts([(2.0, 19.0, 0.0), (1.0, 0.0, 9.0)]) == (2.0 - 1e-6, 2.0 - 1e-6)
    assert pii._cuts([(2.0, 9.0, 0.0), (1.0, 0.0, 9.0)]) == (-float("inf"), float("inf"))


def test_apart_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, 0, 10, 4, 0, 1.0), (0, 8, 20, 5, 0, 2.0), (0, 18, 30, 7, 2, 1.5), (1, 0, 10, 4, 0, 2.0), (1, 8, 20, 5, 0, 1.0), (1, 18, 30, 7, 2, 1.5)]
    for r in range(2, 60):
        for g in range(4, 10):
            at = 0
            for _ in range(rng.randint(0, 4)):
                at += rng.randint(0, 9)
                rows.append((r, at, at := at + rng.randint(1, 12), g, 0, float(rng.randint(-2, 2))))
    want = set()
    for x in sorted(rows, key=lambda x: (x[0], -x[5], x[1] - x[2], x[1], x[3])):
        if all(x[0] != t[0] or x[2] <= t[1] or t[2] <= x[1] for t in want):
            want.add(x[:4])
    df = spark.createDataFrame(rows, "row long, start int, end int, gen int, kind int, margin double")
    got = [tuple(r) for r in pii._apart(df).select("row", "start", "end", "gen").collect()]
    assert sorted(got) == sorted(want) and {x for x in want if x[0] == 1} == {(1, 0, 10, 4), (1, 18, 30, 7)}
