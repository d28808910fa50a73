"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type.  Returns
    (node, root), root being the smallest node of the component, for all nodes
    except the roots themselves.  Every round hangs each node's larger
    neighbours, then its smaller ones, on the least node it sees; the edge set
    never grows, and the number of rounds is logarithmic in practice.  All work
    is keyed aggregation and joins; no neighbour list is ever gathered.
    Null ends and self loops are ignored.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = scratch.keep(ends.selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges-0")
    state = _state(now)
    for i in range(1, max_rounds + 1):
        if not state[0]:
            break
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = (
            both.join(least, "a").where("b > a").selectExpr("b as a", "m as b").where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .selectExpr("explode(array(struct(b as a, m as b), struct(a as a, m as b))) as e")
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        then = scratch.keep(small, f"edges-{i}")
        scratch.drop(f"edges-{i - 1}")
        before, state, now = state, _state(then), then
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.selectExpr("a as node", "b as root")
