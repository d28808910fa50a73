import random

import numpy as np
from oracle import same

from leafmill.llm import urlfilter as u
from leafmill.llm.queries import ORACLES, QUERIES
from leafmill.scratch import Scratch


def test_query(spark, sf):
    same(QUERIES["op7_url_filter"](spark, sf), ORACLES["op7_url_filter"], sf)


def test_cascade_is_exact(spark):
    rng = random.Random(6)
    keys = sorted({rng.getrandbits(64) for _ in range(20_000)})
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long")
    for step in (2, 7, 3000):
        listed = set(keys[::step])
        absent = {rng.getrandbits(64) for _ in range(50)}
        cascade = u.build_cascade(df, listed | absent, Scratch(spark, "t"))
        got = cascade.listed(np.array(keys, np.uint64))
        assert [k in listed for k in keys] == got.tolist()
        first = cascade.levels[0]
        wrong = int(first.has(np.array(keys, np.uint64)).sum()) - len(listed)
        assert wrong <= 2 * len(listed) + 20  # by the size of the list, not of the universe
        bits = sum(len(b.words) for b in cascade.levels) * 64
        assert bits < len(listed) * (1.5 * np.log2(1.5 * len(keys) / len(listed)) + 8) + 512 * len(cascade.levels)
    assert not u.build_cascade(df, [], Scratch(spark, "t")).levels
    assert not u.build_cascade(df.limit(0), keys[:9], Scratch(spark, "t")).levels


def test_lists_of_several_cascades(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.{t}" for i in range(60) for t in ("com", "net", "example.com")]
    rules = [u.Rule(rng.choice(["allow", "block"]), h, rng.choice(["/", "/a/", "/b/c"])) for h in rng.sample(hosts, 50)]
    rules += [u.Rule("allow", "com", "/"), u.Rule("block", "example.com", "/")]
    urls = [f"http://{rng.choice(['', 'x.', 'y.z.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/q', '/b/c?d', '/b/'])}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (u.MOST_BYTES, 300):
        got = u.judge(df, rules=rules, most_bytes=most).collect()
        assert sorted(tuple(r) for r in got) == sorted((i, *slow(x, rules)) for i, x in enumerate(urls))


def slow(url, rules=u.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host), len(r.path)), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme.com/en/", "http://", "http://COM/", "http://com", "http://a.com?x/en/", "x://y://example.com/en/",
        "http://EXAMPLE.com/en/a#b", "http://www.example.com/en/", "http://x.www.example.com/en/q?z", "http://badexample.com/en/",
        "http://net/es/", "http://a..net/fr/x", "http://.com/", "http://é.net/fr/", "http://example.com/EN/", "http://u@b.net:80/fr/", "http://com./",
        "http://a\nb.net/fr/x", "http://net/fr", "http://example.com/en/" + "x" * 50_000, "http://" + "a." * 3000 + "net/es/",
    ]
    rows = [(i, x, "clash") for i, x in enumerate(urls)] + [(None, urls[8], "c"), (3, urls[3], "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = u.judge(df).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *slow(x))) for i, x, _ in rows)
    assert u.judge(df.limit(0)).count() == 0
