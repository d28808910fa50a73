"""Joins of many rows with tables of groups, some of which may be hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of all rows is hot; so there are as many at most.
SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int, share: int = SHARE) -> DataFrame:
    """``rows`` with the other columns of their group.

    ``groups`` has a row for each group of ``keys`` in ``rows``, and in
    ``size`` its number of rows, of ``total`` in all.  Hot groups, ``share`` at
    most, are broadcast; so the shuffle of the rest, if there is any, has no
    key with more than that share of the rows.  Null keys are keys.
    """
    named = groups.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    hot = F.col(size) * share >= F.lit(total)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    drop = [f"_of_{k}" for k in keys]
    many, few = named.where(hot), named.where(~hot)
    out = rows.join(F.broadcast(many), on)
    if not few.isEmpty():
        rest = rows.join(F.broadcast(many.select(*drop)), on, "left_anti")
        out = out.unionByName(rest.join(few, on))
    return out.drop(*drop)
