"""Run matrices: plans, owed work, merged scores, best seeds, restore cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.names import image_id

# fixed values
SWEPT_METHODS = ("ours", "ours_notree", "b1")
METRICS = ("dino", "siglip2", "clip_i", "clip_t", "attribute_accuracy")
CELL = ("species", "method", "name_mode", "ip_scale")


def _options(values: Sequence, kind: str):
    return F.array(*[F.lit(v).cast(kind) for v in values])


def run_matrix(species: DataFrame, methods: Sequence[str], modes: Sequence[str], scales: Sequence[float], seeds: int,
               swept: Sequence[str] = SWEPT_METHODS) -> DataFrame:
    """Planned cells: swept methods at every scale, the others once with NULL scale."""
    plan = species.select("species").withColumn("method", F.explode(_options(methods, "string")))
    per_scale = F.when(F.col("method").isin(*swept), _options(scales, "double")).otherwise(F.array(F.lit(None).cast("double")))
    plan = (plan.withColumn("ip_scale", F.explode(per_scale)).withColumn("name_mode", F.explode(_options(modes, "string")))
            .withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))))
    return plan.select(image_id("species", "method", "name_mode", "ip_scale", "seed").alias("image_id"),
                       "species", "method", "name_mode", "ip_scale", "seed")


def starvation_cells(concepts: DataFrame, levels: Sequence[int], n_draws: int) -> DataFrame:
    return (concepts.select("concept").withColumn("level", F.explode(_options(levels, "int")))
            .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))))


def merge_tables(tables: Sequence[DataFrame], ident: str = "image_id") -> DataFrame:
    """Merge metric tables by id; for a metric in several tables the later one wins."""
    long = None
    for i, t in enumerate(tables):
        names = [c for c in t.columns if c != ident]
        part = t.select(ident, F.lit(i).alias("_src"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("_m")).select(ident, "_src", "_m.*")
        long = part if long is None else long.unionByName(part)
    metrics = sorted({c for t in tables for c in t.columns if c != ident})
    known = long.where(F.col("value").isNotNull())
    return known.groupBy(ident).agg(*[F.max_by("value", F.when(F.col("metric") == m, F.col("_src"))).alias(m) for m in metrics])


def verify_score(part_tree: bool, attr: str = "attribute_accuracy", sims: Sequence[str] = ("part_sim_dino", "part_sim_siglip")):
    """Attribute accuracy, or its mean with the mean of the part similarities that exist."""
    a = F.coalesce(F.col(attr), F.lit(0.0))
    if not part_tree:
        return a
    n = sum(F.col(s).isNotNull().cast("int") for s in sims)
    total = sum(F.coalesce(F.col(s), F.lit(0.0)) for s in sims)
    return 0.5 * F.when(n > 0, total / n).otherwise(F.lit(0.0)) + 0.5 * a


def best_seeds(plan: DataFrame, scores: DataFrame, metrics: Sequence[str] = METRICS, part_tree: bool = False) -> tuple[DataFrame, DataFrame]:
    """(best row per cell, cells without any complete row). Highest verify score, lowest seed on ties."""
    complete = F.lit(True)
    for m in metrics:
        complete = complete & F.col(m).isNotNull()
    j = plan.join(scores, "image_id", "left")
    good = F.when(F.coalesce(complete, F.lit(False)), F.struct((-verify_score(part_tree)).alias("neg"), "seed"))
    per = j.groupBy(*CELL).agg(F.min_by(F.struct("seed", *metrics), good).alias("_b"), F.count(good).alias("_n"))
    rows = per.where(F.col("_n") > 0).select(*CELL, "_b.*")
    return rows, per.where(F.col("_n") == 0).select(*CELL)


def pending(plan: DataFrame, done: DataFrame, output: str) -> DataFrame:
    """Planned outputs not produced yet, duplicates of one output collapsed."""
    return plan.join(done.select(output).distinct(), output, "left_anti").dropDuplicates([output])


def produced(plan: DataFrame, done: DataFrame, output: str) -> DataFrame:
    return plan.join(done.select(output).distinct(), output, "left_semi").dropDuplicates([output])


def completeness(plan: DataFrame, done: DataFrame, output: str) -> DataFrame:
    """Expected and produced output counts."""
    d = done.select(output).distinct().withColumn("_d", F.lit(1))
    return plan.select(output).distinct().join(d, output, "left").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_d").alias("produced"))


def restore_cells(own: DataFrame, targets: DataFrame, levels: Sequence[int], n_draws: int, conditions: Sequence[str]) -> DataFrame:
    """Cells per (concept, part) with own count, k_eff > 0 and targets > 0.

    Levels are clipped to the own count and repeated ones dropped; a draw takes its target
    by modulo.
    """
    base = own.where(F.col("k_eff") > 0).join(targets.where(F.col("n_targets") > 0), ["concept", "part"])
    clipped = F.array_distinct(F.transform(_options(levels, "long"), lambda x: F.least(x, F.col("n_own").cast("long"))))
    cells = (base.withColumn("level", F.explode(clipped)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
             .withColumn("condition", F.explode(_options(conditions, "string"))))
    return cells.select("concept", "part", "level", "draw", "condition", (F.col("draw") % F.col("n_targets")).alias("target"), "k_eff")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in order, as a minimum so hot keys combine early."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    w = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return w.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def first_n_per_label(rows: DataFrame, wanted: DataFrame, label: str, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per wanted label in file order; the limit applies before the shuffle."""
    w = Window.partitionBy(label).orderBy(*order)
    kept = rows.join(wanted.select(label).distinct(), label, "left_semi")
    return kept.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
