"""Personal data: rules, high-recall generators and boosted trees, all in SQL.

Four strict patterns with validity checks give the base spans.  Wider patterns
propose further, overlapping candidates.  Each kind has boosted depth-two trees
that score them by format and context alone.  Their examples are the corpus's
own matches: strict ones that pass their check against those that fail it, and
wider ones outside base spans by their own check, which may also leave open what
they are.  Each wider pattern has a threshold, calibrated for precision on the
half of the documents that the trees have not seen.  Candidates from it on that
fail no check and touch no base span are added, the likeliest first
and none that overlaps one already added.  A pattern without positive examples
there, or with too few of any kind, has no threshold: of its candidates those
that pass their check are added.

The text passes through the patterns once.  What goes on is gaps, matches and a
few characters of context; offsets are running sums over a document's matches.
Features are small numbers, so the examples of a corpus of any size add up to
one table of counts by distinct features, and that is all that the driver reads.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
#: Groups are possessive and starts anchored, so that no text makes the matcher
#: recurse or scan a run twice; the matches are those of the plain patterns.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
GENERATORS = (
    # name, kind, pattern, strict
    ("email", "email", _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    ("ip", "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True),
    ("card", "card", r"[0-9](?:[\x20-]?+[0-9])++", True),
    ("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("email_spelt", "email", _LOCAL + r" ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++", False),
    ("email_local", "email", _LOCAL + r"@[A-Za-z0-9-]++(?!\.?[A-Za-z0-9-])", False),
    ("ip_v6", "ip", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+)(?![0-9A-Za-z:])", False),
    ("card_dots", "card", r"(?<![0-9.])[0-9]{4}(?:[. -][0-9]{4}){2,3}(?:[. -][0-9]{1,3})?(?![0-9])", False),
    ("phone_local", "phone", r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|00[1-9][0-9]{0,2}[ .-]|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", False),
    ("secret", "secret", r"(?i)(?<![A-Za-z])(?:api[_-]?key|key|token|secret|password|passwd)[ ]?[:=][ ]?[\"']?[A-Za-z0-9+/_=-]{12,}+", False),
    ("card_fours", "card", r"(?<![0-9.])[0-9]{4}(?:[. -][0-9]{4}){3}(?![0-9])", False),
)
CONTEXT = (
    r"(?i)(?:mail|contact|@)\W*$",
    r"(?i)(?:tel|phone|call|fax|mobile)\W*$",
    r"(?i)(?:card|visa|account|iban)\W*$",
    r"(?i)(?:ip|host|server|address)\W*$",
    r"(?i)(?:key|token|secret|password)\W*$",
)
LEVELS = {"gen": len(GENERATORS), "digits": 8, "size": 8, "marks": 4, "context": len(CONTEXT) + 1, "before": 4, "after": 4}
ROUNDS = 24
RATE = 0.3
PRECISION = 0.95
#: Fewer examples of a wider pattern say nothing about its precision.
LEAST = 20
#: Put around matches; in a text it is read as another character that no pattern knows.
_MARK, _OTHER = "\x01", "\x02"


def _pieces(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``: (gap, before, hit, after), in order.  ``gap``
    counts code points since the previous match."""
    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    return F.transform(
        F.filter(F.transform(cut, lambda x, i: F.when(i % 2 == 1, i)), lambda i: i.isNotNull()),
        lambda i: F.struct(
            F.length(F.get(cut, i - 1)).alias("gap"),
            F.substring(F.get(cut, i - 1), -24, 24).alias("before"),
            F.get(cut, i).alias("hit"),
            F.substring(F.get(cut, i + 1), 1, 1).alias("after"),
        ),
    )


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    doubled = F.transform(numbers, lambda n, i: F.when(i % 2 == 0, n).when(n < 5, 2 * n).otherwise(2 * n - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))) % 10 == 0


def _valid(gen: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(
        F.split(hit, r"\."),
        lambda x: F.regexp_replace(x, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"),
    )
    return (
        F.when(gen == 0, F.lit(True))
        .when(gen == 1, small)
        .when(gen == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(gen == 3, n.between(9, 15))
        .otherwise(False)
    )


def _check(gen: Column, hit: Column, context: Column) -> Column:
    """Of wider candidates: whether their own form and context speak for them;
    null if these leave it open."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    value = F.regexp_replace(hit, "^[^:=]*[:=] ?[\"']?", "")
    kinds = F.array_distinct(F.split(value, ""))
    digit, letter = value.rlike("[0-9].*[0-9]"), value.rlike("[A-Za-z]")
    one_case = ~value.rlike("[0-9]") & ~(value.rlike("[a-z]") & value.rlike("[A-Z]"))
    elsewhere = context.isin(3, 4, 5)
    return (
        F.when(gen == 4, hit.rlike(r"(?i)[\[(]dot[\])] ?[a-z0-9-]*[a-z]{2}|\.[a-z]{2,}$"))
        .when(gen == 5, F.when(hit.rlike("^[0-9.]+@|@[0-9-]+$"), False).when(context == 1, True))
        .when(
            gen == 6,
            F.when(hit.contains("::"), hit.rlike("[0-9]") & F.size(F.regexp_extract_all(hit, F.lit("[0-9A-Fa-f]+"), F.lit(0))).between(3, 7))
            .when(hit.rlike("^(?:..?:)*..?$"), False)
            .when(hit.rlike("[A-Fa-f]"), True),
        )
        .when(gen.isin(7, 10), n.between(12, 19) & ~digits.rlike(r"^(.)\1*$") & _luhn(digits))
        .when(
            gen == 8,
            F.when(~n.between(9, 15) | elsewhere, False).when(
                (context == 2) | hit.rlike(r"^(?:\(|00)|^[2-9][0-9]{2}[.-][2-9][0-9]{2}[ .-][0-9]{4}$"), True
            ),
        )
        .when(
            gen == 9,
            F.when(F.size(kinds) < 6, False)
            .when(digit & letter, True)
            .when(one_case & ~hit.rlike("[\"']"), False),
        )
    )


def _class(ch: Column) -> Column:
    return F.when((F.length(ch) == 0) | ch.rlike(r"^\s$"), 0).when(ch.rlike("^[0-9]$"), 1).when(ch.rlike(r"^\p{L}$"), 2).otherwise(3)


def _context(before: Column) -> Column:
    out = F.lit(0)
    for k in reversed(range(len(CONTEXT))):
        out = F.when(before.rlike(CONTEXT[k]), k + 1).otherwise(out)
    return out


def candidates(df: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents, candidates).  Documents: (row, id); candidates: (row, half,
    gen, start, end, valid, check, features).  ``row`` is a number for each row
    of ``df``, drawn once and kept; ``half`` is told by the text alone."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _MARK, _OTHER)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    found = F.array(
        *[
            F.when(F.col("text").rlike(need), _pieces(F.col("text"), pattern)).otherwise(F.array()).alias(name)
            for name, _, pattern, _ in GENERATORS
            for need in [r"[0-9@]" if name not in ("email_spelt", "secret") else r"(?i)[\[(]at[\])]|[:=]"]
        ]
    )
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    kept = scratch.keep(rows.select("row", "id", half, found.alias("found")), "matches")
    hits = (
        kept.where(F.exists("found", lambda x: F.size(x) > 0))
        .select("row", "half", F.posexplode("found").alias("gen", "list"))
        .select("row", "half", "gen", F.posexplode("list").alias("seq", "m"))
        .select("row", "half", "gen", "seq", "m.*")
    )
    order = Window.partitionBy("row", "gen").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(order)
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    size = F.length("hit")
    digits = F.length(F.regexp_replace("hit", "[^0-9]", ""))
    marks = F.length(F.regexp_replace("hit", "[A-Za-z0-9]", ""))
    hits = hits.withColumn("context", _context(F.col("before")))
    hits = hits.select(
        "row",
        "half",
        "gen",
        "start",
        "end",
        _valid(F.col("gen"), F.col("hit")).alias("valid"),
        _check(F.col("gen"), F.col("hit"), F.col("context")).alias("check"),
        F.least(F.lit(7), F.ceil(digits / 3)).cast("int").alias("digits"),
        F.least(F.lit(7), F.floor(size / 6)).cast("int").alias("size"),
        F.least(F.lit(3), F.floor(marks / 2)).cast("int").alias("marks"),
        F.col("context").cast("int").alias("context"),
        _class(F.substring(F.col("before"), -1, 1)).cast("int").alias("before"),
        _class(F.col("after")).cast("int").alias("after"),
    )
    return kept.select("row", "id"), scratch.keep(hits, "candidates")


def _strict(gen: Column) -> Column:
    return gen.isin([i for i, g in enumerate(GENERATORS) if g[3]])


def _neighbours(hits: DataFrame) -> DataFrame:
    """Adds ``touches``: whether a strict valid match overlaps.  By running
    extremes in order of start."""
    by = Window.partitionBy("row").orderBy("start", "end", "gen")
    back = by.rowsBetween(Window.unboundedPreceding, -1)
    ahead = by.rowsBetween(1, Window.unboundedFollowing)
    good = _strict(F.col("gen")) & F.col("valid")
    before = F.max(F.when(good, F.col("end"))).over(back) > F.col("start")
    after = F.min(F.when(good, F.col("start"))).over(ahead) < F.col("end")
    return hits.withColumn("touches", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


class Trees:
    """Boosted depth-two trees on small whole features."""

    def __init__(self, bias: float = 0.0):
        self.bias = bias
        self.trees: list[tuple] = []

    @staticmethod
    def _value(tree: tuple, x: Sequence[int]) -> float:
        f, t, kids = tree
        g, u, leaves = kids[x[f] > t]
        return leaves[x[g] > u]

    def margin(self, x: Sequence[int]) -> float:
        return self.bias + sum(self._value(t, x) for t in self.trees)

    def column(self, names: Sequence[str]) -> Column:
        out = F.lit(self.bias)
        for f, t, kids in self.trees:
            leaf = [F.when(F.col(names[g]) > u, v[1]).otherwise(v[0]) for g, u, v in kids]
            out = out + F.when(F.col(names[f]) > t, leaf[1]).otherwise(leaf[0])
        return out

    def fit(self, rows: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
        """``rows``: features with the counts of positive and other examples."""
        if not rows:
            return self
        pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.bias = math.log((pos + 1) / (neg + 1))
        margins = [self.bias] * len(rows)
        splits = [(f, t) for f, n in enumerate(LEVELS.values()) for t in range(n - 1)]

        def best(index: list[int], grad: list[float], hess: list[float]) -> tuple[float, int, int, tuple[float, float]]:
            g_all, h_all = sum(grad[i] for i in index), sum(hess[i] for i in index)
            sums: dict[tuple[int, int], list[float]] = {}
            for i in index:
                for f, v in enumerate(rows[i][0]):
                    s = sums.setdefault((f, v), [0.0, 0.0])
                    s[0] += grad[i]
                    s[1] += hess[i]
            out = (-1.0, 0, 0, (0.0, 0.0))
            left: dict[int, list[float]] = {}
            for f, t in splits:
                run = left.setdefault(f, [0.0, 0.0])
                s = sums.get((f, t), (0.0, 0.0))
                run[0] += s[0]
                run[1] += s[1]
                g, h = run
                gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1)
                if gain > out[0] + 1e-12:
                    out = (gain, f, t, (g / (h + 1), (g_all - g) / (h_all - h + 1)))
            return out

        for _ in range(rounds):
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in margins]
            grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(rows, p, strict=True)]
            hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
            _, f, t, _ = best(list(range(len(rows))), grad, hess)
            kids = []
            for side in (False, True):
                _, g, u, leaves = best([i for i, r in enumerate(rows) if (r[0][f] > t) == side], grad, hess)
                kids.append((g, u, tuple(rate * v for v in leaves)))
            self.trees.append((f, t, tuple(kids)))
            margins = [m + self._value(self.trees[-1], r[0]) for m, r in zip(margins, rows, strict=True)]
        return self


def _cuts(seen: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Of a wider pattern, by (margin, positives, others) of examples: the
    margins from which candidates that pass their check, and those whose check
    leaves it open, are taken.  No positives, or too few examples: the check
    alone decides.  A pattern that is precise enough as a whole loses none that
    pass."""
    if not any(p for _, p, _ in seen) or sum(p + q for _, p, q in seen) < LEAST:
        return -math.inf, math.inf
    at: dict[float, list[float]] = {}
    for m, p, q in seen:
        sums = at.setdefault(round(m, 9), [0.0, 0.0])
        sums[0] += p
        sums[1] += q
    cut, good, bad = math.inf, 0.0, 0.0
    for m in sorted(at, reverse=True):
        good, bad = good + at[m][0], bad + at[m][1]
        if good >= PRECISION * (good + bad):
            cut = m - 1e-6
    return (-math.inf if good >= PRECISION * (good + bad) else cut), cut


def _train(hits: DataFrame) -> tuple[list[Trees], dict[int, tuple[float, float]]]:
    """Trees of each kind and the ``_cuts`` of each wider pattern."""
    names = list(LEVELS)
    label = F.when(_strict(F.col("gen")), F.col("valid")).when(~F.col("touches"), F.col("check")).cast("int")
    table = hits.select(*names, label.alias("y"), "half").where("y is not null")
    table = table.groupBy(*names, "half").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    table = sorted(table, key=lambda r: tuple(r))
    rows = [(tuple(r[n] for n in names), float(r.pos), float(r.n - r.pos), r.half) for r in table]
    kinds = [KINDS.index(g[1]) for g in GENERATORS]
    trees = [Trees().fit([r[:3] for r in rows if r[3] == 0 and kinds[r[0][0]] == k]) for k in range(len(KINDS))]
    cuts = {}
    for g, (_, _, _, strict) in enumerate(GENERATORS):
        if not strict:
            cuts[g] = _cuts([(trees[kinds[g]].margin(r[0]), r[1], r[2]) for r in rows if r[3] == 1 and r[0][0] == g])
    return trees, cuts


def _apart(more: DataFrame) -> DataFrame:
    """Of (row, start, end, gen, kind, margin) the likeliest first, without those
    that overlap one already taken.  Lists are unbroken chains of overlaps."""
    by = Window.partitionBy("row").orderBy("start", "end", "gen")
    fresh = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    more = more.withColumn("group", F.sum(fresh.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct((-F.col("margin")).alias("less"), (F.col("start") - F.col("end")).alias("short"), "start", "gen", "end", "kind")
    chain = more.groupBy("row", "group").agg(F.array_sort(F.collect_list(place)).alias("chain"))

    def step(taken: Column, x: Column) -> Column:
        met = F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
        return F.when(met, taken).otherwise(F.concat(taken, F.array(x)))

    taken = F.aggregate("chain", F.filter("chain", lambda _: F.lit(False)), step)
    return chain.select("row", F.explode(taken).alias("x")).select("row", "x.start", "x.end", "x.gen", "x.kind")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) for each row: arrays of (start, kind, end, name) in
    order of start, then kind.

    ``base`` are the strict, valid matches; ``added`` what the trees take
    beside them, which overlaps neither base spans nor each other.  Null texts
    read as empty; repeated rows come back as often.
    """
    scratch = Scratch(df.sparkSession, "pii")
    docs, hits = candidates(df, scratch, id_col, text_col)
    hits = scratch.keep(_neighbours(hits), "touching")
    trees, cuts = _train(hits)
    kind = F.element_at(F.array(*[F.lit(KINDS.index(g[1])) for g in GENERATORS]), F.col("gen") + 1)
    margin, cut = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, t in enumerate(trees):
        margin = F.when(kind == k, t.column(list(LEVELS))).otherwise(margin)
    for g, (passed, left_open) in cuts.items():
        cut = F.when(F.col("gen") == g, F.when(F.col("check"), F.lit(passed)).when(F.col("check").isNull(), F.lit(left_open))).otherwise(cut)
    scored = hits.select("row", "start", "end", "gen", "valid", "touches", kind.alias("kind"), margin.alias("margin"), cut.alias("cut"))
    base = scored.where(_strict(F.col("gen")) & F.col("valid")).withColumn("origin", F.lit(0))
    more = scored.where(~_strict(F.col("gen")) & ~F.col("touches") & (F.col("margin") >= F.col("cut")))
    spot = ("row", "start", "end", "kind")
    base, more = base.select(*spot, "origin"), _apart(more).select(*spot).withColumn("origin", F.lit(1))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", name.alias("name"))
    spans = base.unionByName(more).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("origin") == 0, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("origin") == 1, span))).alias("added"),
    )
    none = F.array().cast(spans.schema["base"].dataType)
    return docs.join(spans, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")
    )


def spelt(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every span of ``find`` replaced by its kind in brackets.

    Spans of one text that overlap are merged.  Null texts come back empty, null
    and repeated ids with their rows; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    rows = Scratch(df.sparkSession, "redact").keep(rows, "rows")
    found = find(rows, "_row").select("_row", F.array_sort(F.concat("base", "added")).alias("spans"))
    rows = rows.join(found, "_row")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr((acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["name"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], gap, mark).alias("out"), F.greatest(acc["at"], s["end"].cast("long")).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    return rows.select(F.col("id").alias(id_col), done.alias(text_col))
