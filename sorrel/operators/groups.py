"""Group vectors and graph hubs: centroids, coherence, medoids, components, hub tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.functions.vectors import as_vector, cosine, dot, unit
from sorrel.operators.similarity import threshold_forest
from sorrel.session import cut


def vector_mean(df: DataFrame, keys: Sequence[str], vec: str = "vec", out: str = "mean", dim: int | None = None) -> DataFrame:
    """Component-wise mean per key, one partial sum per component; NULL vectors take no part.

    A key without any vector has a NULL mean. ``dim`` is looked up over all rows unless given. A vector of another length is an error.
    """
    keys = list(keys)
    if dim is None:
        low, high = df.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
        if low != high:
            raise ValueError(f"vectors of {low} to {high} components")
        dim = high or 0
    if dim == 0:
        return df.groupBy(*keys).agg(F.first(F.lit(None).cast("array<double>")).alias(out))
    checked = F.when(F.col(vec).isNull() | (F.size(vec) == dim), F.col(vec)).otherwise(
        F.raise_error(F.lit(f"a vector does not have {dim} components")).cast("array<double>"))
    parts = df.select(*keys, checked.alias("_vec")).groupBy(*keys).agg(
        *[F.avg(F.get(F.col("_vec"), F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)])
    return parts.select(*keys, F.when(F.col("_0").isNotNull(), F.array(*[F.col(f"_{i}") for i in range(dim)])).alias(out))


def centroids(df: DataFrame, keys: Sequence[str], vec: str = "vec", out: str = "centroid", dim: int | None = None) -> DataFrame:
    """Mean vector per key, renormalised (a zero mean stays zero)."""
    m = vector_mean(df, keys, vec, "_mean", dim)
    return m.select(*keys, unit("_mean").alias(out))


def coherence(df: DataFrame, keys: Sequence[str], vec: str = "vec", dim: int | None = None) -> DataFrame:
    """Centroid, member count and mean member-to-centroid similarity per key."""
    keys = list(keys)
    c = centroids(df, keys, vec, "_cen", dim)
    stats = df.join(c, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"), F.avg(dot(vec, "_cen")).alias("coherence"))
    return stats.join(c, keys).select(*keys, "n_members", "coherence", F.col("_cen").alias("centroid"))


def medoids(df: DataFrame, keys: Sequence[str], ident: str, vec: str = "vec", full_cosine: bool = False,
            dim: int | None = None) -> DataFrame:
    """The member nearest its group mean, lowest id on ties, as (keys, ident, sim)."""
    keys = list(keys)
    m = vector_mean(df, keys, vec, "_mean", dim) if full_cosine else centroids(df, keys, vec, "_mean", dim)
    score = cosine(vec, "_mean") if full_cosine else dot(vec, "_mean")
    scored = df.join(m, keys).withColumn("_sim", score)
    best = F.min(F.struct((-F.col("_sim")).alias("_neg"), F.col(ident).alias(ident))).alias("_best")
    return scored.groupBy(*keys).agg(best).select(
        *keys, F.col(f"_best.{ident}").alias(ident), (-F.col("_best._neg")).alias("sim"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (u long, v long) edges as (node, root), root = lowest node.

    Alternates large-star and small-star rewrites, each one grouped minimum and one join,
    and checkpoints every round so a lost executor never replays the whole history.
    """
    e = cut(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        # large star: neighbours above a node move to the lowest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: lower neighbours and the node itself move to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        e = cut(small.where(F.col("u") != F.col("v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def threshold_hubs(items: DataFrame, threshold: float, *, ident: str = "id", part: str | None = "part",
                   vec: str = "vec", min_size: int = 3) -> DataFrame:
    """Hub of each item: components of the similarity graph per part, noise = -1.

    Single linkage at one cut. Components smaller than ``min_size`` are noise.
    """
    forest = threshold_forest(items, threshold, ident=ident, vec=vec, group=part)
    comp = components(forest)
    big = comp.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    hubs = comp.join(big.select("root"), "root").select(F.col("node").alias(ident), F.col("root").alias("hub_id"))
    return items.join(hubs, ident, "left").withColumn("hub_id", F.coalesce("hub_id", F.lit(-1)).cast("long"))


def valid_hubs(items: DataFrame, *, hub: str = "hub_id", concept: str = "concept", vec: str = "vec",
               min_concepts: int = 2, min_coherence: float = 0.5, dim: int | None = None) -> DataFrame:
    """Hubs spanning enough concepts and tight enough, with centroid and coherence."""
    members = items.where(F.col(hub) != -1)
    spread = members.groupBy(hub).agg(F.countDistinct(concept).alias("n_concepts"))
    return coherence(members, [hub], vec, dim).join(spread, hub).where(
        (F.col("n_concepts") >= min_concepts) & (F.col("coherence") >= min_coherence))


def hub_tables(items: DataFrame, threshold: float | None, *, ident: str = "id", part: str = "part", concept: str = "concept",
               vec: str = "vec", min_concepts: int = 2, min_coherence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(hub, hub_member): valid hubs per part and their member edges. Parts under 3 items are skipped.

    Hubs are components at ``threshold``, or density clusters where it is None.
    """
    from sorrel.operators.density import density_hubs

    enough = items.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3).select(part)
    kept = items.join(enough, part, "left_semi")
    labelled = cut(density_hubs(kept, ident=ident, part=part, vec=vec) if threshold is None else threshold_hubs(kept, threshold, ident=ident, part=part, vec=vec))
    good = valid_hubs(labelled, concept=concept, vec=vec, min_concepts=min_concepts, min_coherence=min_coherence)
    part_of = labelled.where(F.col("hub_id") != -1).groupBy("hub_id").agg(F.first(part).alias(part))
    hub = good.join(part_of, "hub_id")
    member = labelled.join(good.select("hub_id"), "hub_id", "left_semi").select("hub_id", F.col(ident).alias("instance_id"))
    return hub, member


def hub_of(items: DataFrame, member: DataFrame, ident: str = "id") -> DataFrame:
    """First hub of each item, -1 when it has none."""
    first = member.groupBy("instance_id").agg(F.min("hub_id").alias("hub_id"))
    return items.join(first, F.col(ident) == F.col("instance_id"), "left").drop("instance_id").withColumn(
        "hub_id", F.coalesce("hub_id", F.lit(-1)))


def nearest_other_centroid(items: DataFrame, cents: DataFrame, ident: str, own: str, vec: str = "vec") -> DataFrame:
    """Own-centroid similarity, best other-centroid similarity and their margin per item.

    The best other centroid is an exact top-1 search with the own group excluded, so the
    centroid table may be any size.
    """
    from sorrel.operators.similarity import top_k

    q = items.select(F.col(ident).alias("query_id"), F.col(own).alias("tag"), as_vector(vec).alias("vec"))
    c = cents.select(F.col(own).alias("doc_id"), F.col(own).alias("tag"), F.col("centroid").alias("vec"))
    other = top_k(q, c, 1, tag="tag").select(F.col("query_id").alias(ident), F.col("score").alias("nearest_negative_similarity"))
    mine = items.join(cents.select(own, F.col("centroid").alias("_own")), own).select(
        ident, own, dot(vec, "_own").alias("positive_similarity"))
    return mine.join(other, ident, "left").withColumn(
        "prototype_margin", F.col("positive_similarity") - F.col("nearest_negative_similarity"))

