"""Reference selection: nearest, capped, group-restricted, centroid-ranked; ranks and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.vectors import dot, unit
from sorrel.operators.groups import centroids, vector_mean
from sorrel.operators.similarity import count_above, top_k


def capped(df: DataFrame, keys: list[str], tag: str, order: list[Column], k: int, cap: int, rank: str = "rank") -> DataFrame:
    """Greedy capped walk over scored rows: at most ``cap`` per tag, ``k`` per key, rank from 0."""
    inner = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, tag).orderBy(*order))).where(F.col("_in") <= cap)
    outer = inner.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
    return outer.drop("_in").withColumn(rank, F.col(rank) - 1)


def nearest_others(queries: DataFrame, pool: DataFrame, k: int, *, concept: str = "concept", part: str | None = "part",
                   cap: int | None = None, **ids) -> DataFrame:
    """Plain nearest neighbours among other concepts of the same part."""
    return top_k(queries, pool, k, tag=concept, group=part, cap=cap, **ids)


def nearest_in_group(queries: DataFrame, pool: DataFrame, k: int, group: list[str], *, concept: str = "concept",
                     cap: int = 2, **ids) -> DataFrame:
    """Nearest neighbours sharing all ``group`` columns (hub or family, and part), capped per concept."""
    key = F.when(F.greatest(*[F.col(g).isNull().cast("int") for g in group], F.lit(0)) == 0, F.concat_ws("|", *group))
    return top_k(queries.withColumn("_grp", key), pool.withColumn("_grp", key), k, tag=concept, group="_grp", cap=cap, **ids)


def nearest_to_centroid(items: DataFrame, k: int, *, hub: str = "hub_id", ident: str = "doc_id", concept: str = "concept",
                        vec: str = "vec", cap: int | None = 2, dim: int | None = None) -> DataFrame:
    """Hub members ranked by similarity to the hub centroid, at most ``cap`` per concept."""
    members = items.where(F.col(hub) != -1)
    scored = members.join(centroids(members, [hub], vec, "_cen", dim), hub).withColumn("score", dot(vec, "_cen"))
    order = [F.col("score").desc(), F.col(ident).asc()]
    slim = scored.select(hub, ident, concept, "score")
    if cap is None:
        w = Window.partitionBy(hub).orderBy(*order)
        return slim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    return capped(slim, [hub], concept, order, k, cap)


def hub_borrowed(items: DataFrame, k: int, *, hub: str = "hub_id", ident: str = "doc_id", concept: str = "concept", vec: str = "vec",
                 cap: int = 2, dim: int | None = None, block_rows: int = 4096) -> DataFrame:
    """Per (hub, concept) the hub members of other concepts nearest to the centroid of those members.

    The centroid without a concept is the hub's sum less the concept's own, so no concept
    rereads its hub. Columns: hub, concept, ident, score, rank.
    """
    members = items.where(F.col(hub) != -1)
    size = lambda keys, n: members.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    whole = vector_mean(members, [hub], vec, "_all", dim).join(size([hub], "_n"), hub)
    own = vector_mean(members, [hub, concept], vec, "_own", dim).join(size([hub, concept], "_k"), [hub, concept])
    j = own.join(whole, hub).where(F.col("_n") > F.col("_k"))
    rest = F.zip_with("_all", "_own", lambda a, o: (a * F.col("_n") - o * F.col("_k")) / (F.col("_n") - F.col("_k")))
    key = F.concat_ws("\u0001", F.col(hub).cast("string"), F.col(concept).cast("string"))
    q = j.select(key.alias("query_id"), hub, concept, rest.alias("_rest")).withColumn("vec", unit("_rest"))
    pool = members.select(F.col(ident).alias("doc_id"), hub, concept, F.col(vec).alias("vec"))
    hits = top_k(q, pool, k, tag=concept, group=hub, cap=cap, block_rows=block_rows)
    return q.select("query_id", hub, concept).join(hits, "query_id").select(hub, concept, F.col("doc_id").alias(ident), "score", "rank")


def effective_k(items: DataFrame, k: int, *, hub: str = "hub_id", ident: str = "id", concept: str = "concept", part: str = "part", cap: int = 2) -> DataFrame:
    """How many items each (concept, part) can borrow from its hub: at most ``k`` and ``cap`` per other concept.

    The hub is that of the concept's first item of the part; 0 without one.
    """
    first = items.groupBy(concept, part).agg(F.min_by(hub, ident).alias(hub), F.count(F.lit(1)).alias("n_own"))
    room = items.where(F.col(hub) != -1).groupBy(hub, concept).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("_c"))
    total = room.groupBy(hub).agg(F.sum("_c").alias("_t"))
    j = first.join(total, hub, "left").join(room, [hub, concept], "left")
    other = F.coalesce(F.col("_t"), F.lit(0)) - F.coalesce(F.col("_c"), F.lit(0))
    return j.select(concept, part, "n_own", hub, F.least(F.lit(k), other).alias("k_eff"))


def sibling_rank(queries: DataFrame, pool: DataFrame, *, family: str = "family", concept: str = "concept",
                 part: str = "part", query_id: str = "query_id", doc_id: str = "doc_id", vec: str = "vec") -> DataFrame:
    """Rank (from 1) of the nearest same-family sibling among other concepts, and the sibling count.

    The nearest sibling is a grouped top-1; its rank is one plus the number of rows before
    it. Neither step lists the ranking itself.
    """
    known = queries.where(F.col(family).isNotNull())
    best = nearest_in_group(known, pool, 1, [family, part], concept=concept, cap=1, query_id=query_id, doc_id=doc_id, vec=vec)
    best = best.select(query_id, F.col(doc_id).alias("_mark_doc"), F.col("score").alias("_mark_score"))
    marked = known.join(best, query_id)
    above = count_above(marked, pool, "_mark_score", "_mark_doc", query_id=query_id, doc_id=doc_id, vec=vec,
                        tag=concept, group=part)
    per_family = pool.where(F.col(family).isNotNull()).groupBy(family, part).agg(F.count(F.lit(1)).alias("_nf"))
    per_concept = pool.groupBy(family, part, concept).agg(F.count(F.lit(1)).alias("_nc"))
    counts = (known.select(query_id, family, part, concept).join(per_family, [family, part])
              .join(per_concept, [family, part, concept], "left")
              .select(query_id, (F.col("_nf") - F.coalesce("_nc", F.lit(0))).alias("n_siblings")))
    return above.join(counts, query_id).select(query_id, (F.col("n_above") + 1).alias("sib_rank"), "n_siblings")


def rank_stratum(rank: str) -> Column:
    return F.when(F.col(rank) <= 4, "near").when(F.col(rank) <= 12, "mid").otherwise("far")


def gated_cells(held: DataFrame, ranks: DataFrame, k: int, gate_k: int = 4) -> DataFrame:
    """Cells with two or more held-out items whose best sibling ranks beyond the gate.

    ``held`` has (concept, part, ...), ``ranks`` (concept, part, sib_rank, n_siblings).
    """
    n = held.groupBy("concept", "part").agg(F.count(F.lit(1)).alias("n_targets")).where(F.col("n_targets") >= 2)
    return n.join(ranks, ["concept", "part"]).where(F.col("sib_rank") > gate_k).select(
        "concept", "part", "n_targets", F.least(F.lit(k), F.col("n_siblings")).alias("k_eff"), "sib_rank",
        rank_stratum("sib_rank").alias("stratum"))


def leave_one_out_accuracy(items: DataFrame, ident: str, label: str, vec: str = "vec") -> DataFrame:
    """1-NN label accuracy, per label and overall (label NULL), the item itself excluded."""
    base = items.select(F.col(ident).alias("query_id"), F.col(ident).alias("doc_id"), F.col(label).alias("_label"),
                        F.col(ident).alias("_self"), F.col(vec).alias("vec"))
    nn = top_k(base, base, 1, tag="_self").select("query_id", "doc_id")
    labels = base.select("doc_id", F.col("_label").alias("_nn_label"))
    hits = base.select("query_id", F.col("_label").alias("label")).join(nn, "query_id").join(labels, "doc_id")
    return hits.groupingSets([[], [F.col("label")]], "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("_nn_label")).cast("int")).alias("accuracy"))


def retrieval_quality(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hit@k and mean reciprocal rank over the queries of ``truth`` (query_id, doc_id)."""
    found = hits.join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("_r"))
    per = truth.select("query_id").distinct().join(found, "query_id", "left")
    return per.agg(F.count(F.lit(1)).alias("n_queries"),
                   F.avg(F.coalesce((F.col("_r") < k).cast("int"), F.lit(0))).alias("recall_at_k"),
                   F.avg(F.coalesce(F.lit(1.0) / (F.col("_r") + 1), F.lit(0.0))).alias("mrr"))
