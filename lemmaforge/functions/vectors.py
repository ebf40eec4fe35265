"""Small vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / norm)


def masked_mean(hidden: Column, mask: Column) -> Column:
    """Mean of the rows of hidden (array of arrays) where mask is 1."""
    rows = F.arrays_zip(hidden.alias("h"), mask.alias("m"))
    width = F.size(F.get(hidden, F.lit(0)))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r["h"], lambda a, b: a + b.cast("double") * r["m"].cast("double")))
    count = F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(1e-9)))


def span_pool(pieces: Column, start: Column, end: Column) -> Column:
    """Mean vector of the pieces array<struct<cs, ce, vec>> that overlap the span;
    pieces without width are skipped; if none is left, the first piece's vector."""
    inside = F.filter(pieces, lambda p: (p["ce"] > p["cs"]) & (p["cs"] < end) & (p["ce"] > start))
    vecs = F.transform(inside, lambda p: p["vec"])
    mean = masked_mean(vecs, F.transform(vecs, lambda x: F.lit(1)))
    first = F.transform(F.get(pieces, F.lit(0))["vec"], lambda x: x.cast("double"))
    return F.when(F.size(inside) > 0, mean).otherwise(first)


def argmax(v: Column) -> Column:
    """Place of the first greatest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def linear_head(q: Column, weights: list[list[float]], bias: list[float]) -> Column:
    return F.array(*[dot(q, F.array(*[F.lit(float(x)) for x in w])) + F.lit(float(b)) for w, b in zip(weights, bias)])
