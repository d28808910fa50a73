"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Every source is cut into blocks of about equal size by the leading bits of a
seeded hash of its rows.  A source whose target is r times its size takes whole
passes over its blocks and, for the rest of r, a further pass over the first
blocks of a random order, until the next block would exceed the target.  That
last block is opened: its rows are taken in hash order, found by ever finer
histograms rather than by sorting, so the words taken meet the target to within
a document.

The block draws of all sources form one urn.  A binary tree over the output
shards splits it: each node draws from a multivariate hypergeometric law how
many blocks of each source go left.  A leaf's counts are its exact quotas; it
gets the next blocks of each source's random order and shuffles rows locally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
#: Words of an output shard, and how many shards there are at most; of larger
#: mixtures the shards are larger.
SHARD_WORDS = 1 << 22
MOST_SHARDS = 1 << 16
#: Blocks of all sources together, about; the driver holds some numbers for
#: each, and for each source.
HISTOGRAM = 1 << 17
#: Rows of an opened part of a block that are weighed one by one.
OPEN_ROWS = 256
#: Rows of a block, about, in sources that have too few for more.
BLOCK_ROWS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: ``share`` of all, by weight; what exceeds
    ``most`` times a source is shared again by those below."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_tree(quotas: Sequence[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source (columns) in each shard (rows)."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(first: int, n: int, urn: np.ndarray) -> None:
        if n == 1:
            out[first] = urn
            return
        left = n // 2
        total = int(urn.sum())
        drawn = rng.multivariate_hypergeometric(urn, total * left // n, method="marginals")
        node(first, left, drawn)
        node(first + left, n - left, urn - drawn)

    node(0, shards, np.array(quotas, np.int64))
    return out


class Plan:
    """What of each source is taken, and to which shards its blocks go."""

    def __init__(self, sources: list, sizes: list[int], wanted: list[float], bits: list[int]):
        self.sources, self.sizes, self.wanted, self.bits = sources, sizes, wanted, bits
        self.passes = [int(t // s) if s else 0 for s, t in zip(sizes, wanted, strict=True)]
        self.shards = 1
        self.draws = pa.table({})
        self.opened = pa.table({})


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    source = F.col(f"`{source_col}`").cast("string")
    return df.select(
        F.col(f"`{id_col}`").alias("id"),
        source.alias("source"),
        word_count(text).alias("size"),
        _key(F.col(f"`{id_col}`"), text, source, seed).alias("key"),
    )


def _key(id_: Column, text: Column, source: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_.cast("string"), F.coalesce(text, F.lit("")), source)


def _leading(bits: str) -> Column:
    """The first ``bits`` bits of a key, as a number."""
    return F.expr(f"CASE WHEN {bits} = 0 THEN 0L ELSE shiftrightunsigned(key, 64 - {bits}) END")


def _next(done: str, bits: int) -> Column:
    """The ``bits`` bits of a key that follow the first ``done``."""
    return F.expr(f"shiftrightunsigned(shiftleft(key, {done}), {64 - bits})")


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= HISTOGRAM else rows


def _by_source(rows: DataFrame, spark: SparkSession, made: Plan, **columns: Sequence) -> DataFrame:
    """``rows`` with the number of their source and these columns of it."""
    kinds = {"name": pa.string(), "n": pa.int32(), "bits": pa.int32()}
    values = {"name": made.sources, "n": list(range(len(made.sources))), "bits": made.bits}
    table = pa.table({**{k: pa.array(v, kinds[k]) for k, v in values.items()}, **columns})
    info = _small(spark.createDataFrame(table), len(made.sources))
    return rows.join(info, rows.source.eqNullSafe(info["name"])).drop("name")


def block_bits(rows: int, size: int, total: int) -> int:
    """Leading bits that tell a source's blocks apart: by its share of all
    words, but some rows in each block."""
    most = min(HISTOGRAM * size / max(1, total), rows / BLOCK_ROWS)
    return min(32, int(math.log2(most))) if most >= 1 else 0


def plan(
    keyed: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int | None = None,
    seed: int = SEED,
) -> Plan:
    """Targets, block draws and opened blocks for rows of (source, size, key)."""
    spark = keyed.sparkSession
    got = keyed.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    rows = sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    used = [weights[i % len(weights)] for i in range(len(rows))]
    bits = [block_bits(r["n"], r["size"], sum(sizes)) for r in rows]
    made = Plan([r["source"] for r in rows], sizes, targets(sizes, used, share, most), bits)
    made.shards = shards or max(1, min(MOST_SHARDS, math.ceil(sum(made.wanted) / SHARD_WORDS)))
    counted = _by_source(keyed, spark, made).groupBy("n", _leading("bits").alias("block")).agg(F.sum("size").alias("size")).toArrow()
    weigh = [np.zeros(1 << b, np.int64) for b in bits]
    for n, block, size in zip(*(counted.column(c).to_pylist() for c in ("n", "block", "size")), strict=True):
        weigh[n][block] = size

    rng = np.random.default_rng(seed)
    order = [[rng.permutation(1 << b) for _ in range(p + 1)] for p, b in zip(made.passes, bits, strict=True)]
    whole, edge, pending = [], {}, {}
    for i, b in enumerate(bits):
        last, left = order[i][-1], made.wanted[i] - made.passes[i] * sizes[i]
        run = np.cumsum(weigh[i][last])
        n = int(np.searchsorted(run, left, "right"))
        whole.append(n)
        if n < len(last) and left > 0:
            edge[i] = int(last[n])
            pending[i] = (edge[i], b, left - (int(run[n - 1]) if n else 0))
    below, picks = _open(keyed, spark, made, pending)

    # The urn and its tree; then each shard's blocks, in the order drawn.
    quotas = [p * (1 << b) + w + (i in edge) for i, (p, b, w) in enumerate(zip(made.passes, bits, whole, strict=True))]
    tree = split_tree(quotas, made.shards, rng) if quotas else np.zeros((made.shards, 0), np.int64)
    columns: dict[str, list] = {"n": [], "block": [], "pass": [], "shard": [], "edge": []}
    for i, quota in enumerate(quotas):
        own = [*order[i][:-1], order[i][-1][: whole[i]], *([[edge[i]]] if i in edge else [])]
        turns = [*range(made.passes[i] + 1), *([made.passes[i]] if i in edge else [])]
        mixed = rng.permutation(quota)
        block = np.concatenate([np.asarray(o, np.int64) for o in own])[mixed]
        turn = np.repeat(turns, [len(o) for o in own])[mixed]
        columns["n"].append(np.full(quota, i, np.int32))
        columns["block"].append(block)
        columns["pass"].append(turn.astype(np.int32))
        columns["shard"].append(np.repeat(np.arange(made.shards, dtype=np.int32), tree[:, i]))
        columns["edge"].append((mixed == quota - 1) & (i in edge))
    kinds = (np.int32, np.int64, np.int32, np.int32, bool)
    made.draws = pa.table({k: np.concatenate([np.zeros(0, t), *v]) for (k, v), t in zip(columns.items(), kinds, strict=True)})
    made.opened = pa.table(
        {
            "below": pa.array([_signed(below[i]) if i in below else None for i in range(len(rows))], pa.int64()),
            "picks": pa.array([[_signed(k) for k in picks.get(i, ())] for i in range(len(rows))], pa.list_(pa.int64())),
        }
    )
    return made


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _open(keyed: DataFrame, spark: SparkSession, made: Plan, pending: dict[int, tuple[int, int, float]]) -> tuple[dict, dict]:
    """Of each source with a block on the edge, by (block, its bits, words that
    are left): the key below which rows of the block are taken, and the further
    keys that are.  Finer and finer histograms in the order of keys narrow the
    edge down to a part of few keys, and these are weighed one by one."""
    below: dict[int, int] = {}
    picks: dict[int, list[int]] = {}
    while pending:
        index = list(pending)
        edge = spark.createDataFrame(
            pa.table(
                {
                    "e": pa.array(index, pa.int32()),
                    "prefix": pa.array([_signed(pending[i][0]) for i in index], pa.int64()),
                    "done": pa.array([pending[i][1] for i in index], pa.int32()),
                }
            )
        )
        numbered = _by_source(keyed, spark, made)
        on = (F.col("n") == F.col("e")) & (_leading("done") == F.col("prefix"))
        within = numbered.join(_small(edge, len(index)), on).select("n", "size", "key", "done")
        counts = {r.n: r.c for r in within.groupBy("n").agg(F.count_distinct("key").alias("c")).collect()}
        few = {i for i in index if counts.get(i, 0) <= OPEN_ROWS or pending[i][1] >= 64}
        last = {i: [] for i in few}
        for r in within.where(F.col("n").isin(list(few))).groupBy("n", "key").agg(F.sum("size").alias("size")).collect() if few else ():
            last[r.n].append((r.key & (1 << 64) - 1, int(r["size"])))
        for i in few:
            prefix, done, rest = pending.pop(i)
            below[i] = prefix << (64 - done)
            picks[i] = _fit(sorted(last[i]), rest)
        if pending:
            step = max(1, min(12, 64 - max(d for _, d, _ in pending.values()), int(math.log2(max(2, HISTOGRAM // len(pending))))))
            sums = {i: np.zeros(1 << step, np.int64) for i in pending}
            fine = within.where(~F.col("n").isin(list(few))) if few else within
            for r in fine.groupBy("n", _next("done", step).alias("part")).agg(F.sum("size").alias("size")).collect():
                sums[r.n][r.part] = r["size"]
            for i, (prefix, done, rest) in list(pending.items()):
                run = np.cumsum(sums[i])
                k = min(int(np.searchsorted(run, rest, "right")), len(run) - 1)
                pending[i] = (prefix << step | k, done + step, rest - (int(run[k - 1]) if k else 0))
    return below, picks


def _fit(rows: list[tuple[int, int]], rest: float) -> list[int]:
    """Keys of the rows that still fit, in order; then the exchanges of a taken
    row for another, or for none, that come nearest to ``rest``."""
    sizes = np.array([0, *(size for _, size in rows)], np.int64)
    taken = np.zeros(len(sizes), bool)
    for i in range(1, len(sizes)):
        if sizes[i] <= rest:
            taken[i] = True
            rest -= sizes[i]
    for _ in range(8):
        outs = np.concatenate([[0], np.flatnonzero(taken)])
        ins = np.concatenate([[0], np.flatnonzero(~taken[1:]) + 1])
        off = np.abs(rest - (sizes[ins][None, :] - sizes[outs][:, None]))
        o, i = np.unravel_index(np.argmin(off), off.shape)
        if off[o, i] >= abs(rest):
            break
        rest -= sizes[ins[i]] - sizes[outs[o]]
        taken[outs[o]], taken[ins[i]] = False, True
        taken[0] = False
    return [rows[i - 1][0] for i in np.flatnonzero(taken) if i]


def draws(keyed: DataFrame, made: Plan) -> DataFrame:
    """``keyed`` with (source_size, target, draws): the (pass, shard) pairs that
    take the row.  The joined tables hold a row for each source and for each
    block; beyond ``HISTOGRAM`` sources the first is not broadcast."""
    spark = keyed.sparkSession
    per_source = {"source_size": pa.array(made.sizes, pa.int64()), "target": pa.array(made.wanted, pa.float64())}
    per_source |= {c: made.opened.column(c) for c in made.opened.column_names}
    rows = _by_source(keyed, spark, made, **per_source)
    blocks = spark.createDataFrame(made.draws).groupBy("n", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", "edge"))).alias("all")
    )
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    in_edge = F.coalesce(unsigned("key") < unsigned("below"), F.lit(False)) | F.array_contains("picks", F.col("key"))
    rows = rows.withColumn("block", _leading("bits")).withColumn("in_edge", in_edge)
    rows = rows.join(_small(blocks, made.draws.num_rows // (1 + max(made.passes, default=0))), ["n", "block"], "left")
    kept = F.filter(
        F.coalesce("all", F.array().cast("array<struct<pass:int,shard:int,edge:boolean>>")),
        lambda d: ~d["edge"] | F.col("in_edge"),
    )
    return rows.withColumn(
        "draws", F.transform(kept, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))
    ).drop("n", "block", "bits", "all", "below", "picks", "in_edge")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, shards) for each row.

    ``taken`` is the row's words times the passes that take it; ``shards`` has
    a shard for each of them.  A null text has no words, a null source is a
    source of its own and comes last.  Rows that agree in id, source and text
    are drawn together, so a source misses its target by up to the words of
    the largest such set.  An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    keyed = scratch.keep(_keyed(df, id_col, text_col, source_col, seed), "keyed")
    made = plan(keyed, weights, share, most, shards, seed)
    return draws(keyed, made).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"),
    )


def mixed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The mixture itself: the columns of ``df``, a row for each time the mix
    takes it.  Each shard is a partition, shuffled within.  Nulls, repeated
    rows and empty tables as in ``mix``; rows that tie in the shuffle are of
    one key and pass, that is equal in id, source and text."""
    scratch = Scratch(df.sparkSession, "mixing")
    keyed = scratch.keep(_keyed(df, id_col, text_col, source_col, seed), "keyed")
    made = plan(keyed, weights, share, most, shards, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    source = F.col(f"`{source_col}`").cast("string")
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(row, source.alias("source"), _key(F.col(f"`{id_col}`"), text, source, seed).alias("key"))
    taken = draws(rows, made).select("row", "key", F.explode("draws").alias("draw"))
    place = F.xxhash64(F.lit(seed), F.col("key"), F.col("draw.pass"))
    dealt = taken.repartitionById(made.shards, F.col("draw.shard")).sortWithinPartitions(place)
    return dealt.select("row.*")
