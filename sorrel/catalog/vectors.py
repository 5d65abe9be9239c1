"""Similarity, selection and graph queries over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.catalog.base import ITEMS, big, items, pool_side, queries_side, query, r
from sorrel.functions.vectors import dot, norm, reference_weights, unit
from sorrel.operators import density, groups, sampling, selection
from sorrel.operators.similarity import top_k

_PAIRS = """pairs AS (SELECT a.id AS query_id, b.id AS doc_id, a.concept AS qc, b.concept AS dc, a.family AS qf,
 b.family AS df, a.part AS part, list_inner_product(a.vec, b.vec) AS score
 FROM items a JOIN items b ON a.part = b.part AND a.concept <> b.concept)"""


@query("capped_topk_by_concept", f"""WITH {ITEMS}, {_PAIRS},
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, dc ORDER BY score DESC, doc_id) AS rin FROM pairs),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM i WHERE rin <= 2)
SELECT qc AS concept, count(*)::BIGINT AS n_selected, count(DISTINCT dc)::BIGINT AS n_source_concepts,
 round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score FROM o WHERE rn <= 8 GROUP BY qc""")
def capped_topk_by_concept(spark, sf):
    """Flagship: capped nearest-neighbour selection, summarised per concept."""
    it = items(spark, sf)
    hits = selection.nearest_others(queries_side(it), pool_side(it), 8, cap=2)
    return (hits.join(it.select(F.col("id").alias("query_id"), "concept"), "query_id").groupBy("concept").agg(
        big(F.count(F.lit(1))).alias("n_selected"), big(F.countDistinct("doc_tag")).alias("n_source_concepts"),
        r(F.avg("score")).alias("mean_score"), r(F.min("score")).alias("min_score")))


@query("topk_exact", f"""WITH {ITEMS}, s AS (SELECT a.id AS query_id, b.id AS doc_id,
 list_inner_product(a.vec, b.vec) AS score FROM items a JOIN items b ON a.id <> b.id),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)
SELECT query_id, doc_id, round(score, 9) AS score, rank::BIGINT AS rank FROM x WHERE rank < 5""")
def topk_exact(spark, sf):
    it = items(spark, sf).withColumn("self", F.col("id"))
    hits = top_k(queries_side(it), pool_side(it), 5, tag="self")
    return hits.select("query_id", "doc_id", r("score", 9).alias("score"), big("rank").alias("rank"))


@query("nearest_other_concept", f"""WITH {ITEMS}, {_PAIRS},
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM pairs)
SELECT query_id, doc_id, round(score, 9) AS score, rank::BIGINT AS rank FROM x WHERE rank < 4""")
def nearest_other_concept(spark, sf):
    it = items(spark, sf)
    hits = selection.nearest_others(queries_side(it), pool_side(it), 4)
    return hits.select("query_id", "doc_id", r("score", 9).alias("score"), big("rank").alias("rank"))


@query("group_topk_family", f"""WITH {ITEMS}, {_PAIRS},
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, dc ORDER BY score DESC, doc_id) AS rin FROM pairs WHERE qf = df),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM i WHERE rin <= 2)
SELECT query_id, doc_id, round(score, 9) AS score, rank::BIGINT AS rank FROM o WHERE rank < 4""")
def group_topk_family(spark, sf):
    it = items(spark, sf)
    hits = selection.nearest_in_group(queries_side(it), pool_side(it), 4, ["family", "part"])
    return hits.select("query_id", "doc_id", r("score", 9).alias("score"), big("rank").alias("rank"))


@query("filtered_topk", f"""WITH {ITEMS}, s AS (SELECT a.id AS query_id, b.id AS doc_id,
 list_inner_product(a.vec, b.vec) AS score FROM items a JOIN items b ON a.id <> b.id
 WHERE b.part = 1 AND b.concept IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3 AND n_nationkey < 10)),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)
SELECT query_id, doc_id, round(score, 9) AS score, rank::BIGINT AS rank FROM x WHERE rank < 3""")
def filtered_topk(spark, sf):
    """Kind and allowed-id filters go in before ranking, so k hits come back when k exist."""
    from sorrel.catalog.base import table
    from sorrel.sources.store import search_vectors

    it = items(spark, sf)
    nation = table(spark, sf, "nation").where("n_regionkey < 3 AND n_nationkey < 10")
    vectors = it.select(F.col("id").alias("ref"), F.col("concept").alias("global_id"), F.col("part").alias("kind"), "vec")
    hits = search_vectors(vectors, it.select(F.col("id").alias("query_id"), "vec"), 3, kind=1, allow=nation.select(
        F.col("n_nationkey").cast("long").alias("global_id")), exclude_self=True)
    return hits.select("query_id", F.col("ref").alias("doc_id"), r("score", 9).alias("score"), big("rank").alias("rank"))


@query("random_k_others", f"""WITH {ITEMS}, x AS (SELECT a.id AS query_id, b.id AS doc_id, row_number() OVER (
 PARTITION BY a.id ORDER BY md5('7|' || b.id), b.id) - 1 AS rank FROM items a JOIN items b ON a.part = b.part AND a.concept <> b.concept)
SELECT query_id, doc_id, rank::BIGINT AS rank FROM x WHERE rank < 4""")
def random_k_others(spark, sf):
    it = items(spark, sf)
    return sampling.random_others(queries_side(it), pool_side(it), 4, 7).select("query_id", "doc_id", big("rank").alias("rank"))


@query("sibling_rank", f"""WITH {ITEMS}, {_PAIRS},
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM pairs)
SELECT query_id, min(rn) FILTER (qf = df)::BIGINT AS sib_rank, (count(*) FILTER (qf = df))::BIGINT AS n_siblings,
 CASE WHEN min(rn) FILTER (qf = df) <= 4 THEN 'near' WHEN min(rn) FILTER (qf = df) <= 12 THEN 'mid' ELSE 'far' END AS stratum
FROM x GROUP BY query_id HAVING count(*) FILTER (qf = df) > 0""")
def sibling_rank(spark, sf):
    it = items(spark, sf)
    ranks = selection.sibling_rank(queries_side(it), pool_side(it))
    return ranks.select("query_id", big("sib_rank").alias("sib_rank"), big("n_siblings").alias("n_siblings"),
                        selection.rank_stratum("sib_rank").alias("stratum"))


_MEANS = """long AS (SELECT {k}, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM {src}),
m AS (SELECT {k}, pos, avg(x) AS x FROM long GROUP BY {k}, pos),
mv AS (SELECT {k}, list(x ORDER BY pos) AS mean FROM m GROUP BY {k}),
cen AS (SELECT {k}, list_transform(mean, lambda v: v / sqrt(list_inner_product(mean, mean))) AS cen FROM mv)"""


@query("centroid_coherence", f"""WITH {ITEMS}, {_MEANS.format(k='concept, part', src='items')}
SELECT i.concept, i.part, count(*)::BIGINT AS n_members, round(avg(list_inner_product(i.vec, c.cen)), 6) AS coherence,
 round(any_value(c.cen[1]), 6) AS c0, round(any_value(c.cen[64]), 6) AS c63
FROM items i JOIN cen c USING (concept, part) GROUP BY i.concept, i.part""")
def centroid_coherence(spark, sf):
    c = groups.coherence(items(spark, sf), ["concept", "part"])
    return c.select("concept", "part", big("n_members").alias("n_members"), r("coherence").alias("coherence"),
                    r(F.element_at("centroid", 1)).alias("c0"), r(F.element_at("centroid", 64)).alias("c63"))


@query("medoid", f"""WITH {ITEMS}, {_MEANS.format(k='concept, part', src='items')}
SELECT concept, part, id, round(sim, 6) AS sim FROM (SELECT i.concept, i.part, i.id, list_inner_product(i.vec, c.cen) AS sim,
 row_number() OVER (PARTITION BY i.concept, i.part ORDER BY list_inner_product(i.vec, c.cen) DESC, i.id) AS rn
 FROM items i JOIN cen c USING (concept, part)) WHERE rn = 1""")
def medoid(spark, sf):
    return groups.medoids(items(spark, sf), ["concept", "part"], "id").select("concept", "part", "id", r("sim").alias("sim"))


@query("medoid_full_cosine", f"""WITH {ITEMS}, {_MEANS.format(k='concept', src='items')}
SELECT concept, id, round(sim, 6) AS sim FROM (SELECT i.concept, i.id, list_cosine_similarity(i.vec, c.mean) AS sim,
 row_number() OVER (PARTITION BY i.concept ORDER BY list_cosine_similarity(i.vec, c.mean) DESC, i.id) AS rn
 FROM items i JOIN mv c USING (concept)) WHERE rn = 1""")
def medoid_full_cosine(spark, sf):
    return groups.medoids(items(spark, sf), ["concept"], "id", full_cosine=True).select("concept", "id", r("sim").alias("sim"))


@query("hub_centroid_topk", f"""WITH {ITEMS}, {_MEANS.format(k='family', src='items')},
s AS (SELECT i.family, i.id, i.concept, list_inner_product(i.vec, c.cen) AS score FROM items i JOIN cen c USING (family)),
a AS (SELECT *, row_number() OVER (PARTITION BY family, concept ORDER BY score DESC, id) AS rin FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, id) - 1 AS rank FROM a WHERE rin <= 2)
SELECT family, id, round(score, 6) AS score, rank::BIGINT AS rank FROM b WHERE rank < 4""")
def hub_centroid_topk(spark, sf):
    top = selection.nearest_to_centroid(items(spark, sf), 4, hub="family", ident="id")
    return top.select("family", "id", r("score").alias("score"), big("rank").alias("rank"))


@query("loo_nearest_accuracy", f"""WITH {ITEMS}, x AS (SELECT a.id, a.concept AS label, b.concept AS nn, row_number() OVER (
 PARTITION BY a.id ORDER BY list_inner_product(a.vec, b.vec) DESC, b.id) AS rn FROM items a JOIN items b ON a.id <> b.id)
SELECT CASE WHEN grouping(label) = 1 THEN -1 ELSE label END AS label, count(*)::BIGINT AS n,
 round(avg((label = nn)::INT), 9) AS accuracy FROM x WHERE rn = 1 GROUP BY GROUPING SETS ((), (label))""")
def loo_nearest_accuracy(spark, sf):
    acc = selection.leave_one_out_accuracy(items(spark, sf), "id", "concept")
    return acc.select(big(F.coalesce("label", F.lit(-1))).alias("label"), big("n").alias("n"), r("accuracy", 9).alias("accuracy"))


@query("class_centroid_accuracy", f"""WITH {ITEMS}, {_MEANS.format(k='concept', src="(SELECT * FROM items WHERE part < 3)")},
cand AS (SELECT i.id, i.concept, c.concept AS cand, list_inner_product(i.vec, c.cen) AS sim
 FROM items i JOIN cen c ON i.concept % 5 = c.concept % 5 WHERE i.part = 3),
w AS (SELECT id, concept, first(cand ORDER BY sim DESC, cand) AS won FROM cand GROUP BY id, concept)
SELECT count(*)::BIGINT AS n, round(avg((won = concept)::INT), 9) AS accuracy FROM w""")
def class_centroid_accuracy(spark, sf):
    """Nearest centroid among an item's own class and its siblings, the lower class on ties."""
    it = items(spark, sf)
    cents = groups.centroids(it.where("part < 3"), ["concept"]).select(
        F.col("concept").alias("candidate"), (F.col("concept") % 5).alias("family"), "centroid")
    tests = it.where("part = 3").select("id", "concept", "family", "vec")
    won = tests.join(cents, "family").groupBy("id", "concept").agg(F.max_by("candidate", F.struct(dot("vec", "centroid"), -F.col("candidate"))).alias("won"))
    return won.agg(big(F.count(F.lit(1))).alias("n"), r(F.avg((F.col("won") == F.col("concept")).cast("int")), 9).alias("accuracy"))


@query("prototype_margin", f"""WITH {ITEMS}, {_MEANS.format(k='concept', src='items')}
SELECT i.id, i.concept, round(max(list_inner_product(i.vec, c.cen)) FILTER (c.concept = i.concept), 6) AS positive_similarity,
 round(max(list_inner_product(i.vec, c.cen)) FILTER (c.concept <> i.concept), 6) AS nearest_negative_similarity,
 round(max(list_inner_product(i.vec, c.cen)) FILTER (c.concept = i.concept)
  - max(list_inner_product(i.vec, c.cen)) FILTER (c.concept <> i.concept), 6) AS prototype_margin
FROM items i, cen c GROUP BY i.id, i.concept""")
def prototype_margin(spark, sf):
    it = items(spark, sf)
    m = groups.nearest_other_centroid(it, groups.centroids(it, ["concept"]), "id", "concept")
    return m.select("id", "concept", r("positive_similarity").alias("positive_similarity"),
                    r("nearest_negative_similarity").alias("nearest_negative_similarity"), r("prototype_margin").alias("prototype_margin"))


_TAU = 0.33


@query("hub_components", f"""WITH RECURSIVE {ITEMS}, e AS (SELECT a.id AS u, b.id AS v FROM items a JOIN items b
 ON a.part = b.part AND a.id <> b.id WHERE list_inner_product(a.vec, b.vec) >= {_TAU}),
reach AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON r.seen = e.u),
root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
big AS (SELECT root, count(*) AS n FROM root GROUP BY root HAVING count(*) >= 3)
SELECT i.id, CASE WHEN b.root IS NULL THEN -1 ELSE b.root END::BIGINT AS hub_id
FROM items i LEFT JOIN root r ON i.id = r.node LEFT JOIN big b ON r.root = b.root""")
def hub_components(spark, sf):
    return groups.threshold_hubs(items(spark, sf), _TAU).select("id", big("hub_id").alias("hub_id"))


@query("valid_hubs", f"""WITH RECURSIVE {ITEMS}, e AS (SELECT a.id AS u, b.id AS v FROM items a JOIN items b
 ON a.part = b.part AND a.id <> b.id WHERE list_inner_product(a.vec, b.vec) >= {_TAU}),
reach AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON r.seen = e.u),
root AS (SELECT node, min(seen) AS hub FROM reach GROUP BY node),
mem AS (SELECT i.*, r.hub FROM items i JOIN root r ON i.id = r.node WHERE r.hub IN (SELECT hub FROM root GROUP BY hub HAVING count(*) >= 3)),
{_MEANS.format(k='hub', src='mem')}
SELECT m.hub AS hub_id, any_value(m.part)::BIGINT AS part, count(*)::BIGINT AS n_members, count(DISTINCT m.concept)::BIGINT AS n_concepts,
 round(avg(list_inner_product(m.vec, c.cen)), 6) AS coherence FROM mem m JOIN cen c USING (hub) GROUP BY m.hub
HAVING count(DISTINCT m.concept) >= 2 AND avg(list_inner_product(m.vec, c.cen)) >= 0.5""")
def valid_hubs(spark, sf):
    hub, _ = groups.hub_tables(items(spark, sf), _TAU)
    return hub.select("hub_id", big("part").alias("part"), big("n_members").alias("n_members"),
                      big("n_concepts").alias("n_concepts"), r("coherence").alias("coherence"))


@query("density_hubs")
def density_hubs(spark, sf):
    """Hub of every item by condensed single links; tests hold it against a plain condensation."""
    return density.density_hubs(items(spark, sf)).select("id", "part", big("hub_id").alias("hub_id"))


@query("valid_density_hubs")
def valid_density_hubs(spark, sf):
    """Density hubs that span two concepts and are tight enough, with their part, size and coherence."""
    hub, _ = groups.hub_tables(items(spark, sf), None)
    return hub.select(big("hub_id").alias("hub_id"), "part", big("n_members").alias("n_members"), big("n_concepts").alias("n_concepts"), r("coherence", 9).alias("coherence"))



@query("unit_vectors", f"""WITH {ITEMS} SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm,
 round(vec[1] / sqrt(list_inner_product(vec, vec)), 6) AS u0 FROM items""")
def unit_vectors(spark, sf):
    it = items(spark, sf)
    return it.select("id", r(norm("vec")).alias("norm"), r(F.element_at(unit("vec"), 1)).alias("u0"))


@query("reference_weights", """SELECT c_custkey, n_own::BIGINT AS n_own, n_bor::BIGINT AS n_borrowed,
 round(CASE WHEN n_own = 0 THEN NULL WHEN n_bor > 0 AND n_bor / (2.0 * n_own + n_bor) > 0.7 THEN 0.3 / n_own ELSE 2.0 / (2 * n_own + n_bor) END, 9) AS own_weight,
 round(CASE WHEN n_bor = 0 THEN NULL WHEN n_own > 0 AND n_bor / (2.0 * n_own + n_bor) > 0.7 THEN 0.7 / n_bor ELSE 1.0 / (2 * n_own + n_bor) END, 9) AS borrowed_weight
FROM (SELECT c_custkey, c_custkey % 4 AS n_own, c_nationkey AS n_bor FROM customer)""")
def reference_weights_query(spark, sf):
    from sorrel.catalog.base import table

    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("n_own"), F.col("c_nationkey").alias("n_borrowed"))
    w = c.withColumn("w", reference_weights("n_own", "n_borrowed"))
    return w.select("c_custkey", big("n_own").alias("n_own"), big("n_borrowed").alias("n_borrowed"),
                    r(F.when(F.col("n_own") > 0, F.get("w", F.lit(0))), 9).alias("own_weight"),
                    r(F.when(F.col("n_borrowed") > 0, F.get("w", F.col("n_own"))), 9).alias("borrowed_weight"))


@query("retrieval_quality", f"""WITH {ITEMS}, q AS (SELECT * FROM items WHERE part < 2), d AS (SELECT * FROM items WHERE part >= 2),
x AS (SELECT q.id, q.concept, d.id AS doc, d.concept AS dc, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.vec, d.vec) DESC, d.id) - 1 AS rank FROM q, d),
f AS (SELECT id, min(rank) FILTER (concept = dc) AS r FROM x WHERE rank < 10 GROUP BY id)
SELECT count(*)::BIGINT AS n_queries, round(avg(coalesce((r < 3)::INT, 0)), 9) AS recall_at_k, round(avg(coalesce(1.0 / (r + 1), 0)), 9) AS mrr FROM f""")
def retrieval_quality(spark, sf):
    """Hit rate and reciprocal rank when any item of the query's concept counts as right."""
    it = items(spark, sf)
    q, d = it.where("part < 2"), it.where("part >= 2")
    hits = top_k(queries_side(q), pool_side(d), 10)
    labelled = (hits.join(d.select(F.col("id").alias("doc_id"), F.col("concept").alias("dc")), "doc_id")
                .select("query_id", F.col("dc").alias("doc_id"), "rank"))
    truth = q.select(F.col("id").alias("query_id"), F.col("concept").alias("doc_id"))
    out = selection.retrieval_quality(labelled, truth, 3)
    return out.select(big("n_queries").alias("n_queries"), r("recall_at_k", 9).alias("recall_at_k"), r("mrr", 9).alias("mrr"))


@query("item_fidelity", f"""WITH {ITEMS} SELECT a.id, count(*)::BIGINT AS n_refs, round(avg(list_cosine_similarity(a.vec, b.vec)), 6) AS fidelity
FROM items a JOIN items b ON a.concept = b.concept AND a.part % 2 = 0 AND b.part % 2 = 1 GROUP BY a.id""")
def item_fidelity(spark, sf):
    """Mean cosine of an item to its concept's held-out references.

    A mean of dot products with unit vectors is the dot with their mean, so one grouped
    mean replaces every item-reference pair.
    """
    it = items(spark, sf)
    refs = it.where("part % 2 = 1").select("concept", unit("vec").alias("vec"))
    mean = groups.vector_mean(refs, ["concept"]).join(refs.groupBy("concept").agg(F.count(F.lit(1)).alias("n_refs")), "concept")
    out = it.where("part % 2 = 0").join(mean, "concept")
    return out.select("id", big("n_refs").alias("n_refs"), r(dot(unit("vec"), "mean")).alias("fidelity"))


@query("crop_scorer_accuracy", f"""WITH {ITEMS}, {_MEANS.format(k='concept', src='items')},
s AS (SELECT i.id, i.concept, arg_max(c.concept, list_inner_product(i.vec, c.cen)) AS won FROM items i, cen c GROUP BY i.id, i.concept)
SELECT count(*)::BIGINT AS n, round(avg((won = concept)::INT), 9) AS accuracy FROM s""")
def crop_scorer_accuracy(spark, sf):
    """Share of items whose own concept gives the highest score among all concepts."""
    it = items(spark, sf)
    cents = groups.centroids(it, ["concept"]).select(F.col("concept").alias("doc_id"), F.col("centroid").alias("vec"))
    best = top_k(queries_side(it), cents, 1).join(it.select(F.col("id").alias("query_id"), "concept"), "query_id")
    return best.agg(big(F.count(F.lit(1))).alias("n"), r(F.avg((F.col("doc_id") == F.col("concept")).cast("int")), 9).alias("accuracy"))


@query("hub_borrowed", f"""WITH {ITEMS}, q AS (SELECT DISTINCT family, concept FROM items), o AS (SELECT q.family, q.concept, i.id, i.concept AS ic, i.vec FROM q JOIN items i ON i.family = q.family AND i.concept <> q.concept),
long AS (SELECT family, concept, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM o), m AS (SELECT family, concept, pos, avg(x) AS x FROM long GROUP BY ALL), mv AS (SELECT family, concept, list(x ORDER BY pos) AS mean FROM m GROUP BY ALL),
s AS (SELECT o.family, o.concept, o.id, o.ic, list_inner_product(o.vec, mv.mean) / sqrt(list_inner_product(mv.mean, mv.mean)) AS score FROM o JOIN mv USING (family, concept)),
a AS (SELECT *, row_number() OVER (PARTITION BY family, concept, ic ORDER BY score DESC, id) AS rin FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY family, concept ORDER BY score DESC, id) - 1 AS rank FROM a WHERE rin <= 2)
SELECT family, concept, id, round(score, 6) AS score, rank::BIGINT AS rank FROM b WHERE rank < 4""")
def hub_borrowed(spark, sf):
    """Items borrowed by each concept from its group, ranked by the centroid of the others."""
    h = selection.hub_borrowed(items(spark, sf), 4, hub="family", ident="id")
    return h.select("family", "concept", "id", r("score").alias("score"), big("rank").alias("rank"))


@query("effective_k", f"""WITH {ITEMS}, h AS (SELECT *, CASE WHEN id % 7 = 0 THEN -1 ELSE (id // 100 + part) % 6 END AS hub FROM items), f AS (SELECT concept, part, arg_min(hub, id) AS hub, count(*) AS n_own FROM h GROUP BY concept, part),
c AS (SELECT hub, concept, least(count(*), 2) AS c FROM h WHERE hub <> -1 GROUP BY hub, concept)
SELECT f.concept, f.part, n_own::BIGINT AS n_own, f.hub::BIGINT AS hub_id, least(15, coalesce((SELECT sum(c) FROM c WHERE c.hub = f.hub AND c.concept <> f.concept), 0))::BIGINT AS k_eff FROM f""")
def effective_k(spark, sf):
    it = items(spark, sf)
    h = it.withColumn("hub_id", F.when(F.col("id") % 7 == 0, -1).otherwise((F.floor(F.col("id") / 100) + F.col("part")) % 6))
    e = selection.effective_k(h, 15)
    return e.select("concept", "part", big("n_own").alias("n_own"), big("hub_id").alias("hub_id"), big("k_eff").alias("k_eff"))
