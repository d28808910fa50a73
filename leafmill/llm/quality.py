"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is the log-odds of a logistic model of its text's
form.  Sites add theirs: hosts and the paths below them have beta posteriors of
the share of good documents, from grouped sums of the documents' evidence.  The
priors' strengths come from the spread between groups (method of moments), so a
sparse path is drawn to its host and a sparse host to the whole corpus.  The
final probability multiplies the document's likelihood ratio with the odds of
its path, both without the document itself, so that it votes once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.joins import join_groups
from leafmill.scratch import Scratch

#: Labelled documents that the text model is fitted on, at most.
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.5
_COMMON = bytes(range(0x80, 0x100)) + b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n.,;:'\"()-?/"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("symbols", "upper", "repeated", "echoed", "lines", "width", "length", "blank")


def features(text: bytes | None) -> list[float]:
    """What a text looks like, each between 0 and about 1, in the order of FEATURES."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, size = len(words), max(1, len(text))
    echoed = sum(map(bytes.__eq__, words, words[1:]))
    # Of a long text even plain words come again: compare with what length makes usual.
    usual = 0.06 * np.log1p(n) if n else 0.0
    return [
        min(1.0, 4 * len(text.translate(None, _COMMON)) / size),
        (len(text) - len(text.translate(None, _UPPER))) / size,
        max(0.0, 1 - len(set(words)) / n - usual) if n else 0.0,
        echoed / (n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, abs(size / (n + 1) - 6.5) / 30),
        np.log1p(n) / 10,
        float(not n),
    ]


def _feature_batches(text_at: int, kept: int):
    """The first ``kept`` columns, and the features of column ``text_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(text_at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[:kept], "x"]
            )

    return run


def featured(df: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, whole: bool = False) -> DataFrame:
    """(id, host, path, x), and if ``whole`` the columns of ``df`` as _0, _1, ..."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{host_col}`").cast("string").alias("host"),
        F.col(f"`{path_col}`").cast("string").alias("path"),
        *([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)] if whole else []),
        *([] if whole and isinstance(df.schema[text_col].dataType, T.StringType) else [text.alias("text")]),
    )
    kept = 3 + len(df.columns) * whole
    text_at = kept if "text" in rows.columns else 3 + df.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields[:kept], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_feature_batches(text_at, kept), schema)


@dataclass
class TextModel:
    """Logistic model; ``prior`` is the share of good rows it was fitted on."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    prior: float

    def log_odds(self, x):
        """Column of log-odds of label 1, from the feature array ``x``."""
        out = F.lit(self.bias)
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            out = out + F.lit(w / s) * (x[i] - F.lit(m))
        return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> TextModel:
    """Ridge logistic regression by Newton steps.  Without rows, or with one
    label only, the model knows no more than the smoothed share of label 1."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        return TextModel([0.0] * k, [1.0] * k, [0.0] * k, float(np.log(prior / (1 - prior))), prior)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w = np.zeros(k + 1)
    keep = np.diag([ridge] * k + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - keep @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, grad)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return TextModel(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]), prior)


def held_out(doc_id) -> bool:
    """Labels of these documents are never learnt from."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def train(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, limit: int = TRAIN_ROWS) -> TextModel:
    """Fits on labelled rows of (id, x) outside the held-out fold: those with
    the least hashes of the id, at most ``limit``, and of repeated ids one."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    known = known.where(f"crc32(cast(id as string)) % {FOLDS} <> 0").orderBy(F.xxhash64("id"), "id").limit(limit)
    sample = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")).orderBy("id").collect()
    x = np.array([r.x for r in sample], float).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([float(r.y) for r in sample]))


def _strength(prior, n, mean_n, spread) -> float:
    """Pseudo-counts of a beta prior with this mean, given the spread between
    groups of ``mean_n`` rows: spread = p (1 - p) (1 / n + 1 / (1 + strength))."""
    between = spread - prior * (1 - prior) / max(mean_n, 1e-9)
    floor = prior * (1 - prior)
    return float(np.clip(floor / max(between, floor / 1e4) - 1, 1.0, 1e4)) if n > 1 else 1e4


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    limit: int = TRAIN_ROWS,
    whole: bool = False,
) -> DataFrame:
    """(id, host, path, evidence, host_rate, path_rate, score, keep) per row,
    and if ``whole`` the row itself as a struct ``row``.

    ``evidence`` is the document's log likelihood ratio, ``host_rate`` and
    ``path_rate`` are posterior shares of good documents among the others of
    its host and path, ``score`` is the final probability.  A null text reads
    as empty; a null host or path is a group of its own.  Repeated rows come
    back as often and count as often.  Without labels every document keeps the
    prior of one half and stays.  An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "quality")
    rows = scratch.keep(featured(df, id_col, text_col, host_col, path_col), "features")
    model = train(rows, labels, id_col, label_col, limit)
    base = float(np.log(model.prior / (1 - model.prior)))
    odds = model.log_odds(F.col("x"))
    with_odds = {"odds": odds, "p": 1 / (1 + F.exp(-odds))}
    scored = rows.withColumns(with_odds).drop("x")

    # Sums by path, then by host, then of all: each from the one before.
    sums = scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n"))
    paths = scratch.keep(sums, "paths")
    hosts = scratch.keep(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")), "hosts")
    all_ = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    good, n = float(all_.good or 0), int(all_.n or 0)
    prior = (good + 1) / (n + 2)
    a = _spread(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n")), F.lit(prior), prior)
    paths = scratch.keep(join_groups(paths, hosts, ["host"], "host_n", n), "sums")
    b = _spread(paths, (F.col("host_good") + a * prior) / (F.col("host_n") + a), prior)

    # A document is judged by the others of its groups: its own share goes.
    rest = lambda col, own: F.greatest(F.lit(0.0), F.col(col) - own)
    p = F.col("p")
    above = (F.lit(good) - p + 1) / (F.lit(float(n)) + 1)
    host_rate = (rest("host_good", p) + a * above) / (F.col("host_n") - 1 + a)
    path_rate = (rest("good", p) + b * F.col("host_rate")) / (F.col("n") - 1 + b)
    evidence = F.col("odds") - F.lit(base)
    score = 1 / (1 + F.exp(-(evidence + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    if whole:  # Texts are read again, which is cheaper than a copy of them all.
        scored = featured(df, id_col, text_col, host_col, path_col, True).withColumns(with_odds).drop("x")
    out = join_groups(scored, paths, ["host", "path"], "n", n)
    out = out.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("score", score)
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        evidence.alias("evidence"),
        "host_rate",
        "path_rate",
        "score",
        (F.col("score") >= threshold).alias("keep"),
        *([F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns)]).alias("row")] if whole else []),
    )


def _spread(groups: DataFrame, parent, prior: float) -> float:
    """Strength of the prior at ``parent``, weighing groups by their rows."""
    rate = F.col("good") / F.col("n")
    got = groups.agg(
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n")) / F.sum(F.lit(1))).alias("mean"),
        (F.sum(F.col("n") * (rate - parent) * (rate - parent)) / F.sum("n")).alias("spread"),
    ).first()
    return _strength(prior, got.k, got["mean"] or 0.0, got.spread or 0.0)
