"""Toxic passages by maximum-scoring segments.

Tokens score their log-odds between toxic and clean documents under an
informative Dirichlet prior, less a multiple of its standard error, so that
rare words claim nothing; all tokens lose a constant drift.  One linear scan
finds every maximal scoring segment of a text.  Segment scores become E-values
by the extreme-value law of local maxima, E = K n exp(-lambda S): lambda solves
sum p(w) exp(lambda s(w)) = 1 over the tokens of clean text, K is fitted to
clean documents.  A logistic curve over the best and the summed log E-values,
fitted on documents that the token model has not seen, gives the probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.scratch import Scratch

#: Labelled documents that the model is fitted on, at most; half of each label.
TRAIN_ROWS = 20_000
FOLDS = 5
PRIOR = 50.0
ERRORS = 2.0
DRIFT = 0.5
SIGNIFICANT = 0.05
_SPLIT = bytes(c if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and whatever is beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint and in order.

    Every token scored above 0 opens a candidate, with the running sums at its
    two ends.  A candidate is joined to the nearest earlier one that begins
    lower, if that one ends lower too; each join removes a candidate, so the
    scan is linear in the number of tokens.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before start, sum at end, earlier candidate that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        now = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                now[4] = j
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


@dataclass
class ToxicityModel:
    scores: dict[bytes, float] = field(default_factory=dict)
    default: float = -DRIFT
    decay: float = 1.0
    scale: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = 0.0

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens, and (start, end, score, E-value) of each segment."""
        words = tokens(text)
        get, default = self.scores.get, self.default
        scores = np.array([get(w, default) for w in words])
        size = self.scale * max(1, len(words))
        return len(words), [(s, e, x, float(size * np.exp(-self.decay * x))) for s, e, x in maximal_segments(scores)]

    def evidence(self, n: int, found: list) -> list[float]:
        surprise = [-np.log(max(e, 1e-300)) for *_, e in found]
        return [
            float(np.clip(max(surprise, default=-5.0), -5, 40)),
            float(np.log1p(sum(x for x in surprise if x > -np.log(SIGNIFICANT)))),
            float(np.log1p(n)) / 5,
        ]

    def probability(self, evidence: list[float]) -> float:
        x = self.bias + sum(w * v for w, v in zip(self.weights, evidence, strict=True))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {}
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(k, Counter()).update(set(tokens(t)))
    for k, c in counts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([k] * len(c), pa.int32()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
            ["cell", "token", "n"],
        )


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, toxic and clean document counts of either part) of ``sample``."""
    counted = sample.select((F.col("part") * 2 + F.col("y")).cast("int").alias("cell"), "text").mapInArrow(
        _count_batches, "cell int, token binary, n long"
    )
    cell = lambda k: F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0))
    return counted.groupBy("token").agg(
        cell(0).alias("fit0"), cell(1).alias("fit1"), cell(2).alias("cal0"), cell(3).alias("cal1")
    )


def token_scores(n1: Column, n0: Column, all1: float, all0: float, kinds: int) -> Column:
    """A token's score before drift, from its counts in toxic and clean
    documents, the sums of these over all tokens, and the number of tokens."""
    whole = max(1.0, all1 + all0)
    a = 1.0 + PRIOR * (n1 + n0) / whole
    share1, share0, size = (all1 + 1) / (whole + 2), (all0 + 1) / (whole + 2), kinds + PRIOR
    one, none = n1 + a * share1, n0 + a * share0
    rest1 = F.greatest(F.lit(1.0), F.lit(all1 + size * share1) - one)
    rest0 = F.greatest(F.lit(1.0), F.lit(all0 + size * share0) - none)
    log_odds = F.log(one / rest1) - F.log(none / rest0)
    sure = F.greatest(F.lit(0.0), F.abs(log_odds) - ERRORS * F.sqrt(1 / one + 1 / none))
    return F.when(n1 + n0 > 0, F.signum(log_odds) * sure).otherwise(0.0)


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(x scores) = 1, for scores of negative mean."""
    low, high = 1e-3, 5.0
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    if f(high) <= 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    return high


def _token_model(counts: DataFrame, parts: Sequence[str]) -> ToxicityModel:
    """Scores from the counts of these parts of the sample.  Tokens that score
    nothing stay where they are; only the sum of their shares is asked for."""
    n1, n0 = (sum((F.col(p + y) for p in parts), F.lit(0.0)) for y in "10")
    rows = counts.select("token", n1.alias("n1"), n0.alias("n0"))
    sums = rows.agg(F.count(F.lit(1)).alias("k"), F.sum("n1").alias("a"), F.sum("n0").alias("b")).first()
    all1, all0 = float(sums.a or 0), float(sums.b or 0)
    share = F.col("n0") + PRIOR * (F.col("n1") + F.col("n0")) / max(1.0, all1 + all0)
    scored = rows.select("token", token_scores(F.col("n1"), F.col("n0"), all1, all0, sums.k).alias("raw"), share.alias("share"))
    rest = scored.where("raw = 0").agg(F.sum("share").alias("share")).first().share or 0.0
    got = scored.where("raw <> 0").orderBy("token").toArrow()
    raw = got.column("raw").to_numpy()
    model = ToxicityModel(dict(zip(map(bytes, got.column("token").to_pylist()), (raw - DRIFT).tolist(), strict=True)))
    shares = np.append(got.column("share").to_numpy(), rest)
    if shares.sum():
        model.decay = _decay(np.append(raw, 0.0) - DRIFT, shares / shares.sum())
    return model


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    z = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    keep = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - keep @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, grad)
        w += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return tuple(w[:-1].tolist()), float(w[-1])


def _evidence_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            n, best, x = [], [], []
            for t in batch.column(1).to_pylist():
                size, found = m.passages(t)
                n.append(float(size))
                best.append(max((s for _, _, s, _ in found), default=0.0))
                x.append(m.evidence(size, found))
            kinds = (pa.float64(), pa.float64(), pa.list_(pa.float64()))
            columns = [pa.array(v, k) for v, k in zip((n, best, x), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["y", "n", "best", "x"])

    return run


def _evidence(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    """(y, n, best, x): tokens, best segment and evidence of each text."""
    sent = sample.sparkSession.sparkContext.broadcast(model)
    return sample.select("y", "text").mapInArrow(_evidence_batches(sent), "y int, n double, best double, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits on labelled documents outside the held-out fold, at most ``limit``,
    half of each label: those with the least hashes of the id.  Equal texts
    count once.  Conflicting labels of one id read as toxic."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(f"id is not null and y in (0, 1) and crc32(cast(id as string)) % {FOLDS} <> 0")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(limit // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("text").alias("h")).agg(
        F.min("text").alias("text"), F.max("y").alias("y")
    )
    sample = scratch.keep(sample.select("y", "text", (F.pmod("h", F.lit(3)) == 0).cast("int").alias("part")), "sample")
    counts = scratch.keep(token_counts(sample).where("fit1 + cal1 + fit0 + cal0 > 1"), "tokens")
    half, full = _token_model(counts, ("fit",)), _token_model(counts, ("fit", "cal"))

    # On the other part: first the scale, from clean texts, then the curve over
    # the evidence that the model gives with it.
    other = sample.where("part = 1")
    gumbel = F.avg(F.lit(half.decay) * F.col("best") - F.log(F.greatest("n", F.lit(1.0))))
    mean = _evidence(other.where("y = 0"), half).agg(gumbel.alias("m")).first().m
    if mean is not None:  # mean of a Gumbel law: lambda S - ln n = ln K + 0.5772
        half.scale = full.scale = float(np.clip(np.exp(mean - 0.5772), 1e-6, 1.0))
    seen = _evidence(other, half).select("y", "x").collect()
    y = np.array([r.y for r in seen], float)
    real = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    full.bias = float(np.log(real / (1 - real)))
    if len(y) and y.min() != y.max():
        full.weights, bias = _fit_curve(np.array([r.x for r in seen]), y)
        drawn = (y.sum() + 1) / (len(y) + 2)
        full.bias += bias - float(np.log(drawn / (1 - drawn)))
    return full


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            held, scores, passages = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = m.passages(t)
                held.append(zlib.crc32(str(i).encode()) % FOLDS == 0 if i is not None else None)
                scores.append(m.probability(m.evidence(n, found)))
                passages.append(
                    [{"start": s, "end": e, "score": x, "e_value": v} for s, e, x, v in found if v <= SIGNIFICANT]
                )
            kind = pa.list_(
                pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array(passages, kind)],
                ["id", "held_out", "score", "passages"],
            )

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    limit: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted, passages) for each row.

    ``passages`` are the significant segments as ranges of tokens.  Only the
    text bears on the score.  Null texts read as empty; the held-out mark of a
    null id is null.  Without labels all scores are one half.  Repeated rows
    come back as often.
    """
    model = train(docs, labels, id_col, text_col, label_col, limit)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = T.ArrayType(
        T.StructType(
            [
                T.StructField("start", T.IntegerType()),
                T.StructField("end", T.IntegerType()),
                T.StructField("score", T.DoubleType()),
                T.StructField("e_value", T.DoubleType()),
            ]
        )
    )
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("passages", found),
        ]
    )
    scored = rows.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )
