"""Ordered running aggregates that never sort a whole key in one task.

A plain window without a limit puts each key, however large, into one task. Here a
key's rows are cut into value ranges, every range is scanned on its own, and the
totals of the other ranges of the key (a few rows) are added back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.session import cut

_FRAMES = {
    "upto": (Window.unboundedPreceding, 0),
    "before": (Window.unboundedPreceding, -1),
    "from": (0, Window.unboundedFollowing),
    "after": (1, Window.unboundedFollowing),
    "all": (Window.unboundedPreceding, Window.unboundedFollowing),
}
_AGGS = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def bucketed(df: DataFrame, keys: Sequence[str], order: str, rows_per_bucket: int = 500_000,
             max_buckets: int = 256, bucket: str = "_bucket") -> DataFrame:
    """Add a bucket number that grows with ``order`` inside each key.

    Cut points are approximate quantiles, so bucket sizes are even whatever the
    distribution; a key of more than ``max_buckets`` buckets has each range between two
    quantiles cut further by value. Equal values share a bucket, so aggregate repeated
    values first.
    The result is checkpointed because quantile sketches may differ between runs
    while every reader must see the same buckets.
    """
    probs = [i / max_buckets for i in range(1, max_buckets)]
    cuts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).cast("double").alias("_min"), F.max(order).cast("double").alias("_max"), F.percentile_approx(F.col(order), probs, 10_000).alias("_cuts"))
    wanted = F.least(F.lit(max_buckets), F.ceil(F.col("_n") / rows_per_bucket))
    step = F.lit(max_buckets) / wanted
    chosen = F.when(wanted <= 1, F.array().cast("array<double>")).otherwise(
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), (wanted - 1).cast("int")),
            lambda i: F.get(F.col("_cuts"), F.floor(i * step).cast("int") - 1).cast("double"))))
    finer = F.greatest(F.lit(1), F.ceil(F.col("_n") / (rows_per_bucket * max_buckets)))
    cuts = cuts.select(*keys, chosen.alias("_cuts"), finer.alias("_finer"), "_min", "_max")
    if list(keys) == ["_whole"]:
        cuts = F.broadcast(cuts)  # one row
    marked = df.join(cuts, list(keys))
    value = F.col(order).cast("double")
    place = F.size(F.filter("_cuts", lambda c: c < value))
    low, high = F.coalesce(F.get("_cuts", place - 1), F.col("_min")), F.coalesce(F.get("_cuts", place), F.col("_max"))
    inside = F.when(high > low, F.least(F.floor((value - low) / (high - low) * F.col("_finer")), F.col("_finer") - 1)).otherwise(0)
    marked = marked.withColumn(bucket, place * F.col("_finer") + F.greatest(inside, F.lit(0))).drop("_cuts", "_finer", "_min", "_max")
    return cut(marked)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str],
                 outputs: dict[str, tuple[str, Column | str, str]], **bucket_options) -> DataFrame:
    """Add running aggregates over (``order``, ``ties``) within ``keys``.

    ``outputs`` maps a column name to (sum | max | min, expression, frame), the frame
    being one of upto, before, from, after, all. ``order`` must be numeric. Empty
    frames give NULL.
    """
    columns, keys = df.columns, list(keys)
    if not keys:
        df, keys = df.withColumn("_whole", F.lit(0)), ["_whole"]
    return _scan_ranges(bucketed(df, keys, order, **bucket_options), keys, [order, *ties], outputs, columns)


def tuple_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               outputs: dict[str, tuple[str, Column | str, str]]) -> DataFrame:
    """``ordered_scan`` over columns of any sortable types, compared one after the other, NULL first.

    Ranges are cut over the whole tuple of keys and order, so rows that agree in the first
    columns still spread over tasks; only rows equal in all of them share a range. Their order
    among themselves is not defined: aggregate repeated tuples first. No rows give no rows.
    """
    columns, keys = df.columns, list(keys)
    if not keys:
        df, keys = df.withColumn("_whole", F.lit(0)), ["_whole"]
    ranged = df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id())
    return _scan_ranges(cut(ranged), keys, order, outputs, columns, null_keys=keys != ["_whole"])


def _scan_ranges(b: DataFrame, keys: Sequence[str], order: Sequence[str],
                 outputs: dict[str, tuple[str, Column | str, str]], columns: Sequence[str], null_keys: bool = False) -> DataFrame:
    """Scan every (keys, _bucket) on its own and add the totals of the key's other buckets.

    Plain equality keeps the partitioning of the windows; ``null_keys`` keeps rows whose keys are NULL.
    """
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("_bucket")
    expr = {n: (F.col(e) if isinstance(e, str) else e) for n, (_, e, _) in outputs.items()}
    totals = b.groupBy(*keys, "_bucket").agg(*[_AGGS[k](expr[n]).alias(n) for n, (k, _, _) in outputs.items()])
    outer_frame = {"upto": "before", "before": "before", "from": "after", "after": "after", "all": "all"}
    offsets = totals.select(*[F.col(c).alias(f"_on_{c}") for c in [*keys, "_bucket"]], *[
        _AGGS[k](n).over(outer.rowsBetween(*_FRAMES[outer_frame[f]])).alias(f"_off_{n}")
        for n, (k, _, f) in outputs.items()])
    local = b.select("*", *[
        (F.lit(None) if f == "all" else _AGGS[k](expr[n]).over(inner.rowsBetween(*_FRAMES[f]))).alias(f"_loc_{n}")
        for n, (k, _, f) in outputs.items()])
    same = every(F.col(c).eqNullSafe(F.col(f"_on_{c}")) if null_keys else F.col(c) == F.col(f"_on_{c}") for c in [*keys, "_bucket"])
    joined = local.join(offsets, same)
    return joined.select(*columns, *[
        (F.col(f"_off_{n}") if f == "all" else _combine(k, F.col(f"_loc_{n}"), F.col(f"_off_{n}"))).alias(n)
        for n, (k, _, f) in outputs.items()])


def dense_numbers(names: DataFrame, column: str, out: str) -> DataFrame:
    """Number the distinct values of a column of any type from 0 in their order.

    Values are dealt to ranges of the whole value, which are numbered apart; only the size of
    each range crosses between them.
    """
    ranged = cut(names.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_off", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ranged.withColumn("_own", own).join(before.select("_part", "_off"), "_part").select(column, (F.col("_own") - 1 + F.col("_off")).cast("long").alias(out))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Linear-interpolation quantile per key from value counts, without buffering a key."""
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_scan(counted, keys, value, [], {
        "_hi": ("sum", "_c", "upto"), "_n": ("sum", "_c", "all")})
    pos = (F.col("_n") - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)
    first = F.col("_hi") - F.col("_c")
    holds = lambda p: (first <= p) & (p < F.col("_hi"))
    picked = ranked.where(holds(lo) | holds(hi)).groupBy(*keys).agg(
        F.max(F.when(holds(lo), F.col(value))).alias("_a"), F.max(F.when(holds(hi), F.col(value))).alias("_b"),
        F.max(pos - lo).alias("_w"))
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(out))


def every(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
