"""Arm means and paired contrasts between arms, with their tests and intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.functions.scores import exact_signed_rank_tail, finite, normal_upper_tail, signed_rank_upper_tail
from sorrel.operators.scan import exact_quantile, ordered_scan

MIN_INTERVAL_N = 5
HARM_MARGIN = -0.02
GAIN_MARGIN = 0.02


def where_equal(df: DataFrame, **pairs) -> DataFrame:
    """Rows whose columns equal the given values; None matches NULL."""
    for name, value in pairs.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def known(metric: str) -> Column:
    """Metric present and not NaN."""
    return F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))


def numeric_means(df: DataFrame, key: str, tags: Sequence[str] = ("ip_scale", "n_heldout")) -> DataFrame:
    """Mean of every numeric column per key, tag columns excluded, absent values skipped."""
    kinds = (T.NumericType,)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in {key, *tags}]
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def paired_units(df: DataFrame, unit: Sequence[str], arm: str, metric: str, a: str, b: str, order: str) -> DataFrame:
    """One row per unit having both arms; the last row by ``order`` stands for a repeated one."""
    pick = lambda v: F.max_by(F.col(metric), F.when(F.col(arm) == v, F.struct(order, metric)))
    return (df.where(F.col(metric).isNotNull() & F.col(arm).isin(a, b)).groupBy(*unit)
            .agg(pick(a).alias("a"), pick(b).alias("b"))
            .where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("delta", F.col("a") - F.col("b")))


def paired_summary(units: DataFrame, strict: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean delta and win rate; a win is delta >= 0, or > 0 when ``strict``. NULL when empty."""
    win = F.col("delta") > 0 if strict else F.col("delta") >= 0
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"), F.avg(win.cast("int")).alias("win_rate"))


def best_sweep_value(df: DataFrame, sweep: str, metric: str, scope: Column) -> DataFrame:
    """Sweep value with the highest mean metric in scope; the smallest value present on a tie or no data."""
    per = df.where(F.col(sweep).isNotNull()).groupBy(sweep).agg(F.avg(F.when(scope, F.col(metric))).alias("_m"))
    top = per.agg(F.max("_m").alias("_top"), F.min(sweep).alias("_low"))
    won = per.join(F.broadcast(top)).groupBy().agg(
        F.count_if(F.col("_m") == F.col("_top")).alias("_ties"),
        F.max(F.when(F.col("_m") == F.col("_top"), F.col(sweep))).alias("_best"), F.max("_low").alias("_low"))
    return won.select(F.when(F.col("_ties") == 1, F.col("_best")).otherwise(F.col("_low")).alias(sweep))


def named_minus_neutral(df: DataFrame, best: DataFrame, sweep: str, metrics: Sequence[str]) -> DataFrame:
    """(method, metric, delta) of named against neutral at the best sweep value, else over all rows."""
    marked = df.join(F.broadcast(best.withColumnRenamed(sweep, "_best")))
    at = F.col(sweep).eqNullSafe(F.col("_best"))
    aggs = [F.bool_or(at).alias("_has")]
    for m in metrics:
        for mode in ("named", "neutral"):
            is_mode = F.col("name_mode") == mode
            aggs += [F.avg(F.when(is_mode & at, F.col(m))).alias(f"_{m}_{mode}_at"),
                     F.avg(F.when(is_mode, F.col(m))).alias(f"_{m}_{mode}_all")]
    per = marked.groupBy("method").agg(*aggs)
    side = lambda m, mode: F.when(F.col("_has"), F.col(f"_{m}_{mode}_at")).otherwise(F.col(f"_{m}_{mode}_all"))
    deltas = F.array(*[F.struct(F.lit(m).alias("metric"), (side(m, "named") - side(m, "neutral")).alias("delta")) for m in metrics])
    return per.select("method", F.explode(deltas).alias("_d")).select("method", "_d.metric", "_d.delta")


def recovery_curve(df: DataFrame, metric: str, by: Sequence[str] = ("condition", "level")) -> DataFrame:
    return df.where(known(metric)).groupBy(*by).agg(F.avg(metric).alias("mean_metric"))


def cell_deltas(df: DataFrame, cell: Sequence[str], draw: str, arm: str, metric: str, a: str, b: str,
                pair_draws: bool) -> DataFrame:
    """Delta per cell between two arms.

    ``pair_draws`` pairs each draw and averages the differences; otherwise each arm is
    averaged over its own draws first. They differ when a draw lacks one arm.
    """
    rows = df.where(known(metric) & F.col(arm).isin(a, b))
    sides = [F.avg(F.when(F.col(arm) == v, F.col(metric))).alias(n) for v, n in ((a, "a"), (b, "b"))]
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    if pair_draws:
        per_draw = rows.groupBy(*cell, draw).agg(*sides).where(both)
        return per_draw.groupBy(*cell).agg(F.avg(F.col("a") - F.col("b")).alias("delta"))
    return rows.groupBy(*cell).agg(*sides).where(both).select(*cell, (F.col("a") - F.col("b")).alias("delta"))


def wilcoxon(cells: DataFrame, keys: Sequence[str] = (), value: str = "delta", exact_upto: int = 50, method: str = "auto") -> DataFrame:
    """Signed-rank test per key: n of nonzero deltas, W+, z, two-sided and one-sided (greater) p.

    Average ranks of absolute values, zeros dropped. ``method`` gives p: "exact" from the distribution of
    rank sums, ties included (a key's distinct ranks come to one task; time grows with about the power 1.5
    of untied pairs), "normal" with tie correction, and "auto" exact for up to ``exact_upto`` untied nonzero
    deltas, else normal. All-zero input gives z and one-sided p NULL and two-sided p 1.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method}")
    keys = list(keys)
    v = F.col(value)
    total = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    counted = cells.where(known(value) & (v != 0)).groupBy(*keys, F.abs(v).alias("_a")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(v > 0).alias("_p"))
    ranked = ordered_scan(counted, keys, "_a", [], {"_hi": ("sum", "_c", "upto")})
    rank = F.col("_hi") - (F.col("_c") - 1) / 2.0
    stats = ranked.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.sum(F.col("_p") * rank).alias("w_plus"),
        F.sum(F.col("_c").cast("double") * F.col("_c") * F.col("_c") - F.col("_c")).alias("_ties"),
        *([F.collect_list(F.struct((2 * F.col("_hi") - F.col("_c") + 1).cast("long").alias("twice"), F.col("_c").alias("n"))).alias("_ranks")] if method == "exact" else []))
    if not keys:
        out = stats.join(F.broadcast(total))
    else:
        out = total.join(stats, keys, "left")
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var))
    out = out.withColumn("z", z)
    small = (F.col("n") <= exact_upto) & (F.col("_ties") == 0) & F.lit(method == "auto")
    w_max = F.greatest(F.col("w_plus"), n * (n + 1) / 2 - F.col("w_plus"))
    # Python functions run on every row, whatever the branch: a large n must not reach the exact one
    few = F.when(small, F.col("n"))
    upper = F.when(small, signed_rank_upper_tail(few, F.col("w_plus"))).otherwise(normal_upper_tail("z"))
    two = F.when(small, signed_rank_upper_tail(few, w_max)).otherwise(normal_upper_tail(F.abs(F.col("z"))))
    if method == "exact":
        upper, two = exact_signed_rank_tail("_ranks", "w_plus"), exact_signed_rank_tail(F.col("_ranks"), w_max)
    return out.select(*keys, "n_all", F.coalesce("n", F.lit(0)).alias("n_nonzero"), "w_plus", "z",
                      F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * two)).alias("p_two_sided"),
                      F.when(F.col("n") > 0, upper).alias("p_greater"))


def contrast_by_stratum(cells: DataFrame, stratum: str) -> DataFrame:
    """Overall (stratum NULL) and per-stratum n, mean delta and strict win rate."""
    return cells.groupingSets([[], [F.col(stratum)]], stratum).agg(
        F.grouping(stratum).alias("overall"), F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"),
        F.avg((F.col("delta") > 0).cast("int")).alias("win_rate"))


def recovery_by_stratum(df: DataFrame, cell: Sequence[str], arm: str, stratum: str, metric: str) -> DataFrame:
    per = df.where(known(metric)).groupBy(*cell, arm).agg(F.avg(metric).alias("_m"), F.max(stratum).alias(stratum))
    return per.groupBy(arm, stratum).agg(F.avg("_m").alias("mean_metric"))


def reliability_sweep(units: DataFrame, count: str, thresholds: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """Per threshold, statistics over the units counted at least that often (groups overlap)."""
    wide = units.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(count))))
    base = wide.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("sd"),
        F.count_if(F.col("delta") > 0).alias("wins"), F.avg((F.col("delta") > 0).cast("int")).alias("win_rate"),
        (F.sum(F.col(count) * F.col("delta")) / F.sum(count)).alias("weighted_mean"))
    med = exact_quantile(wide, ["threshold"], "delta", 0.5, "median")
    test = wilcoxon(wide, ["threshold"]).select("threshold", "z", F.col("p_greater").alias("wilcoxon_p"))
    return base.join(med, "threshold").join(test, "threshold")


def audit_rates(df: DataFrame, part: str = "part") -> DataFrame:
    """Per part: n, reference and generated hit rates, mean similarity of scored rows."""
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ref_box").cast("int")).alias("ref_hit_rate"),
        F.avg(F.col("gen_box").cast("int")).alias("gen_hit_rate"), F.avg("sim").alias("mean_sim"), F.count("sim").alias("n_scored"))


# --- intervals ---------------------------------------------------------------

_BLOCK = 50_000


#: Blocks whose replicate sums are added up by one task before those of a key meet.
_MERGED = 1024
_SUMS = "_key string, _block long, _n long, _sums array<double>, _low double, _high double"


def _interval(sums: np.ndarray, n: int, alpha: float) -> tuple[float, float]:
    low, high = np.quantile(sums / n, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


def _sums_row(key: str, block: int, n: int, sums: np.ndarray | None, low: float | None, high: float | None) -> pa.RecordBatch:
    return pa.record_batch([pa.array([key], pa.string()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64())),
                            pa.array([low], pa.float64()), pa.array([high], pa.float64())], ["_key", "_block", "_n", "_sums", "_low", "_high"])


def _merge_sums(alpha: float | None):
    """Adds up the packed sums of a group one block at a time; with ``alpha`` it ends in the interval."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, name, n = None, key[0].as_py(), 0
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2)[0].as_py()
            for i in range(batch.num_rows):
                if not batch.column(3)[i].is_valid:
                    yield batch.slice(i, 1)
                    continue
                sums = batch.column(3)[i].values.to_numpy()
                total = sums.copy() if total is None else total + sums
        if total is not None:
            block = key[1].as_py() if len(key) > 1 else 0
            yield _sums_row(name, block, n, total if alpha is None else None, *((None, None) if alpha is None else _interval(total, n, alpha)))

    return run


def _resample_kernel(n_boot: int, seed: int, alpha: float):
    def draws(key: str, level: int, node: int) -> np.random.Generator:
        import hashlib

        digest = hashlib.sha256(f"{seed}|{key}|{level}|{node}".encode()).digest()
        return np.random.default_rng(int.from_bytes(digest[:8], "big"))

    def kernel(table: pa.Table) -> pa.Table:
        key = table.column("_key")[0].as_py()
        block = table.column("_block")[0].as_py()
        sizes = table.column("_path")[0].as_py()
        values = np.sort(table.column("_value").to_numpy())
        # walk down the block tree: each split hands a binomial share to the left child
        quota = np.full(n_boot, table.column("_n")[0].as_py(), dtype=np.int64)
        depth = len(sizes)
        for level, pair in enumerate(sizes):
            left, right = pair["left"], pair["right"]
            node = block >> (depth - level)
            share = draws(key, level, node).binomial(quota, left / (left + right))
            quota = share if not (block >> (depth - level - 1)) & 1 else quota - share
        rng = draws(key, depth, block)
        sums = np.array([values[rng.integers(0, len(values), q)].sum() for q in quota])
        n = table.column("_n")[0].as_py()
        # the only block of its key needs no other sums
        row = _sums_row(key, block, n, sums, None, None) if depth else _sums_row(key, block, n, None, *_interval(sums, n, alpha))
        return pa.Table.from_batches([row])

    return kernel


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str = "delta", *, n_boot: int = 10_000, seed: int = 0,
                 alpha: float = 0.05, block_rows: int = _BLOCK, ident: str | None = None) -> DataFrame:
    """Seeded percentile interval of the mean per key; NULL below five observations.

    Drawing n of n values with replacement is the same as first drawing how many land in
    each block (a chain of binomials down a tree of blocks) and then drawing inside the
    blocks. So each block resamples alone and ships its sums as one packed array, added up
    in two steps; a key of one block ends where it was drawn. No replicate is ever a row.
    """
    keys = list(keys)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]) if keys else F.lit("all")
    rows = df.where(known(value)).withColumn("_key", key).withColumn("_value", F.col(value).cast("double"))
    salt = F.xxhash64(*[F.col(c) for c in ([ident] if ident else df.columns)])
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.avg("_value").alias("_mean"), *[F.first(k).alias(k) for k in keys])
    depth = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_n") / block_rows))).cast("int")
    sizes = sizes.withColumn("_depth", depth)
    # keys too small for an interval are not resampled
    enough = F.col("_n") >= MIN_INTERVAL_N
    placed = rows.select("_key", "_value", salt.alias("_salt")).join(sizes.where(enough).select("_key", "_n", "_depth"), "_key")
    placed = placed.withColumn("_block", F.pmod("_salt", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_depth"))))
    blocks = placed.groupBy("_key", "_block", "_depth").agg(F.count(F.lit(1)).alias("_c"))
    nodes = blocks.select("_key", "_depth", "_c", F.explode(F.when(F.col("_depth") > 0, F.transform(
        F.sequence(F.lit(0), F.col("_depth") - 1), lambda lv: F.struct(
            lv.alias("level"), F.call_function("shiftright", F.col("_block"), F.col("_depth") - lv).alias("node"),
            (F.call_function("shiftright", F.col("_block"), F.col("_depth") - lv - 1) % 2).alias("bit"))))).alias("_s"))
    splits = nodes.groupBy("_key", "_s.level", "_s.node").agg(
        F.sum(F.when(F.col("_s.bit") == 0, F.col("_c")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("_s.bit") == 1, F.col("_c")).otherwise(0)).alias("right"))
    on_path = blocks.select("_key", "_block", F.explode_outer(F.when(F.col("_depth") > 0, F.transform(
        F.sequence(F.lit(0), F.col("_depth") - 1), lambda lv: F.struct(
            lv.alias("level"), F.call_function("shiftright", F.col("_block"), F.col("_depth") - lv).alias("node"))))).alias("_s"))
    paths = (on_path.select("_key", "_block", "_s.level", "_s.node").join(splits, ["_key", "level", "node"], "left")
             .groupBy("_key", "_block").agg(F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct(
                 "level", "left", "right")))).alias("_path")))
    fed = placed.join(paths, ["_key", "_block"]).select("_key", "_block", "_n", "_path", "_value")
    drawn = fed.groupBy("_key", "_block").applyInArrow(_resample_kernel(n_boot, seed, alpha), _SUMS)
    some = drawn.groupBy("_key", F.floor(F.col("_block") / _MERGED).alias("_part")).applyInArrow(_merge_sums(None), _SUMS)
    bounds = some.groupBy("_key").applyInArrow(_merge_sums(alpha), _SUMS).select("_key", "_low", "_high")
    return sizes.join(bounds, "_key", "left").select(
        *keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"), F.col("_low").alias("ci_low"), F.col("_high").alias("ci_high"))


def harm_verdict(low, high) -> Column:
    lo, hi = F.col(low), F.col(high)
    return F.when(lo.isNull(), F.lit(None)).when(lo >= HARM_MARGIN, "no_harm").when(hi < 0, "harm").otherwise("inconclusive")


def gain_verdict(mean, low, high) -> Column:
    m, lo, hi = F.col(mean), F.col(low), F.col(high)
    return (F.when(lo.isNull(), "UNDERPOWERED").when((m >= GAIN_MARGIN) & (lo > 0), "GAIN")
            .when((m <= -GAIN_MARGIN) & (hi < 0), "LOSS").otherwise("NO_LARGE_EFFECT"))


def heldout_bucket(n: str) -> Column:
    c = F.col(n)
    return F.when(c <= 1, "held<=1").when(c <= 2, "held2").when(c <= 4, "held3-4").otherwise("held5+")


__all__ = [n for n in dir() if not n.startswith("_")] + ["finite"]
