"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; an error where their lengths differ."""
    size = norm(a) * norm(b)
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error("vectors of different lengths").cast("double"))


def _bytes(digests: Column) -> Column:
    """The bytes of hexadecimal digests, as numbers between -0.5 and 0.5.  Each
    digest is an element of an array, so that it is computed once."""
    pair = lambda d, i: F.conv(d.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: pair(d, i) / 255 - 0.5)))


def unit(vector: Column) -> Column:
    """Scaled to length one; a zero vector as it is.  The vector is bound as an
    element of an array, and its length beside it, so both are computed once."""
    bound = F.transform(F.array(vector), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    scaled = F.transform(bound, lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))
    return F.get(scaled, F.lit(0))


def hash_embedding(text: Column, dim: int = 8, scaled: bool = True) -> Column:
    """A deterministic stand-in for an embedding service: bytes of SHA-256 of
    the text and a counter, centred, and scaled to length one."""
    digests = F.array(*[F.sha2(F.concat(text, F.lit(f":{k}")), 256) for k in range(-(-dim // 32))])
    vector = F.slice(_bytes(digests), 1, dim)
    return unit(vector) if scaled else vector
