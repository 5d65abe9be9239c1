"""Cutting a table into small ranges of an integer key, without sorting it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles of the key that reach the driver.
CUTS = 64


def range_buckets(df: DataFrame, key: str, rows_per_bucket: int) -> Column:
    """A bucket number that rises with the integer column ``key``, about ``rows_per_bucket`` rows each.

    Approximate quantiles cut the keys into at most ``CUTS`` ranges with known counts, and every
    range is cut evenly by value into as many buckets as its count asks for. Equal keys share a
    bucket; null keys have bucket -1. The numbers depend on the data through the quantiles, so
    use one returned column for everything that must agree.
    """
    key_col = F.col(key).cast("long")
    probs = [i / CUTS for i in range(1, CUTS)]
    low, high, cuts = df.agg(F.min(key_col), F.max(key_col), F.percentile_approx(key_col, probs, 10_000)).first()
    if low is None:
        return F.lit(-1).cast("long")
    edges = sorted({low, *(c + 1 for c in cuts if c < high)})
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:]]), lambda e: e <= key_col))
    counts = dict(df.where(key_col.isNotNull()).groupBy(place.alias("p")).count().collect())
    base, bases, parts = 0, [], []
    for p in range(len(edges)):
        bases.append(base)
        parts.append(max(1, -(-counts.get(p, 0) // rows_per_bucket)))
        base += parts[-1]
    ends = [*edges[1:], high + 1]
    ranges = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(float(e - s)).alias("w"), F.lit(b).cast("long").alias("b"), F.lit(n).cast("long").alias("n"))
                       for s, e, b, n in zip(edges, ends, bases, parts)])
    own = F.element_at(ranges, place + 1)
    inside = F.floor((key_col - own["s"]).cast("double") / own["w"] * own["n"])
    return F.when(key_col.isNull(), F.lit(-1)).otherwise(own["b"] + F.least(inside, own["n"] - 1)).cast("long")
