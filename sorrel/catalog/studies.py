"""Whole studies, record assembly and user-function adapters."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sorrel import udf
from sorrel.catalog import evaluation as ev
from sorrel.catalog import files as fl
from sorrel.catalog.base import big, items, query, r, table
from sorrel.catalog.documents import concept_list
from sorrel.catalog.knowledge import _READS, reads
from sorrel.functions import names
from sorrel.operators import consensus, paired, verdicts
from sorrel.plans import studies
from sorrel.sources import files

_REF = 0.3


@query("detector_study_arms", f"""WITH {ev._LABELLED}, a AS (SELECT truth_fail, 'semantic_only' AS arm, NOT semantic_ok AS p FROM lab UNION ALL SELECT truth_fail, 'reference_only', reference_relevance < 0.3 FROM lab
 UNION ALL SELECT truth_fail, 'union', NOT semantic_ok OR reference_relevance < 0.3 FROM lab) {ev.conf_sql('a', 'truth_fail', 'p', 'arm')}""")
def detector_study_arms(spark, sf):
    """The fixed baselines of the fold study, over the same held-out rows."""
    arms = studies.detector_study(ev.labelled(spark, sf), _REF)["arms"]
    return ev.conf_out(arms.where("arm <> 'guarded'"), "arm")


@query("detector_study")
def detector_study(spark, sf):
    """Held-out detector result and its gates."""
    s = studies.detector_study(ev.labelled(spark, sf), _REF)
    return s["gates"].join(F.broadcast(s["readiness"])).select("name", r("value", 9).alias("value"), "passed", "readiness")


@query("development_study")
def development_study(spark, sf):
    """Detector and selector folds with the readiness gates, cohort intervals and both policies fitted on all rows, as (part, name, value, passed)."""
    cand = ev.candidates(spark, sf)
    cohorts = cand.select("case_id").distinct().withColumn("cohort", F.when(F.col("case_id") % 3 == 0, "bridge").otherwise("common"))
    s = studies.development_study(ev.labelled(spark, sf), cand, cohorts, _REF, judged=True)
    none = F.lit(None).cast("boolean")

    def rows(part, df, key, names):
        cells = F.array(*[F.struct(F.concat_ws("/", key, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
        return df.select(F.lit(part).alias("part"), F.explode(cells).alias("_c")).select("part", "_c.name", r("_c.value", 6).alias("value"), none.alias("passed"))

    every = F.lit("all")
    gates = s["gates"].join(F.broadcast(s["readiness"])).select(F.concat(F.lit("gate "), "readiness").alias("part"), "name", r("value", 6).alias("value"), "passed")
    return (gates.unionByName(rows("cohort", s["cohorts"], F.col("cohort"), ["n", "mean", "ci_low", "ci_high", "improved", "unchanged", "worsened"]))
            .unionByName(rows("detector folds", s["folds"].groupBy("text_threshold", "reference_threshold").agg(F.sum("n").alias("n")),
                              F.concat_ws(",", r("text_threshold", 9), r("reference_threshold", 9)), ["n"]))
            .unionByName(rows("selector folds", s["margins"].groupBy("text_margin", "reference_margin").agg(F.count(F.lit(1)).alias("n")),
                              F.concat_ws(",", r("text_margin", 9), r("reference_margin", 9)), ["n"]))
            .unionByName(rows("detector policy", s["detector_policy"], every, ["text_threshold", "reference_threshold", "feasible", "recall", "mcc"]))
            .unionByName(rows("selector policy", s["selector_policy"], every, ["text_margin", "reference_margin", "feasible", "mean_delta", "exact_best_rate"])))


_RETRO = f"""{ev._CAND}, rw AS (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'bridge' ELSE 'common' END AS cohort, case_id % 2 = 0 AS truth_fail, semantic_ok, reference_relevance FROM cand WHERE attempt = 0),
d AS (SELECT case_id, text_relevance AS dt, reference_relevance AS dr, dino AS dd FROM cand WHERE attempt = 0),
b AS (SELECT c.case_id, attempt, row_number() OVER (PARTITION BY c.case_id ORDER BY text_relevance DESC, reference_relevance DESC, attempt) AS rn FROM cand c JOIN d USING (case_id) WHERE attempt > 0 AND text_relevance - dt + 1e-12 >= 0.02 AND reference_relevance - dr > 0),
o AS (SELECT case_id, arg_min(attempt, (-dino, attempt)) AS oracle FROM cand GROUP BY case_id),
x AS (SELECT rw.*, NOT semantic_ok OR reference_relevance < 0.3 AS routed, CASE WHEN NOT semantic_ok OR reference_relevance < 0.3 THEN coalesce(b.attempt, 0) ELSE 0 END AS selected FROM rw LEFT JOIN b ON b.case_id = rw.case_id AND rn = 1),
y AS (SELECT x.*, oracle, c.dino - dd AS delta FROM x JOIN cand c ON c.case_id = x.case_id AND c.attempt = x.selected JOIN d ON d.case_id = x.case_id JOIN o ON o.case_id = x.case_id)"""


def _retro(spark, sf):
    cand = ev.candidates(spark, sf)
    rows = cand.where("attempt = 0").select("case_id", F.when(F.col("case_id") % 3 == 0, "bridge").otherwise("common").alias("cohort"), (F.col("case_id") % 2 == 0).alias("truth_fail"), "semantic_ok", "reference_relevance")
    return studies.retrospective(rows, cand, _REF, 0.02)


@query("retrospective_detector", f"""WITH {_RETRO}, a AS (SELECT truth_fail, 'semantic' AS arm, NOT semantic_ok AS p FROM y UNION ALL SELECT truth_fail, 'reference', reference_relevance < 0.3 FROM y UNION ALL SELECT truth_fail, 'union', routed FROM y) {ev.conf_sql('a', 'truth_fail', 'p', 'arm')}""")
def retrospective_detector(spark, sf):
    return ev.conf_out(_retro(spark, sf)["detector"], "arm")


@query("retrospective_selector", f"""WITH {_RETRO} SELECT count(*)::BIGINT AS cases, round(avg((selected = oracle)::INT), 9) AS exact_best, round(avg(delta), 9) AS mean_delta, count(*) FILTER (delta < -0.02)::BIGINT AS harmful FROM y""")
def retrospective_selector(spark, sf):
    s = _retro(spark, sf)["selector"]
    return s.select(big("cases").alias("cases"), r("exact_best", 9).alias("exact_best"), r("mean_delta", 9).alias("mean_delta"), big("harmful").alias("harmful"))


@query("retrospective_cohorts", f"""WITH {_RETRO} SELECT cohort, count(*)::BIGINT AS n, round(avg(delta), 9) AS mean_delta, count(*) FILTER (delta > 0)::BIGINT AS improved, count(*) FILTER (delta = 0)::BIGINT AS unchanged, count(*) FILTER (delta < 0)::BIGINT AS worsened FROM y GROUP BY cohort""")
def retrospective_cohorts(spark, sf):
    c = _retro(spark, sf)["cohorts"]
    return c.select("cohort", big("n").alias("n"), r("mean_delta", 9).alias("mean_delta"), *[big(x).alias(x) for x in ("improved", "unchanged", "worsened")])


_SIGNS = """e AS (SELECT (text_relevance - dt + 1e-12 >= 0.02 AND reference_relevance - dr > 0) = (dino > dd) AS hit FROM cand c JOIN d USING (case_id) WHERE attempt > 0),
sg AS (SELECT count(*)::BIGINT AS comparisons, CASE WHEN count(*) > 0 THEN count(*) FILTER (hit) / count(*)::DOUBLE ELSE 0 END AS sign_accuracy FROM e)"""


@query("retrospective_signs", f"WITH {_RETRO}, {_SIGNS} SELECT comparisons, round(sign_accuracy, 9) AS sign_accuracy FROM sg")
def retrospective_signs(spark, sf):
    return _retro(spark, sf)["selector"].select(big("comparisons").alias("comparisons"), r("sign_accuracy", 9).alias("sign_accuracy"))


@query("retrospective_gates", f"""WITH {_RETRO}, {_SIGNS}, k AS (SELECT count(*) FILTER (truth_fail) AS f, count(*) FILTER (NOT truth_fail) AS p, count(*) FILTER (truth_fail AND routed) AS tp,
 count(*) FILTER (NOT truth_fail AND routed) AS fp, count(*) FILTER (delta < -0.02) AS harmful FROM y)
SELECT 'detector' AS name, f > 0 AND p > 0 AND tp / f >= 0.733 AND fp <= 1 AS passed, CASE WHEN f = 0 THEN 'missing FAIL stratum' WHEN p = 0 THEN 'missing PASS stratum' END AS reason FROM k
UNION ALL SELECT 'selector', comparisons > 0 AND sign_accuracy >= 0.75 AND harmful <= 1, NULL FROM k, sg""")
def retrospective_gates(spark, sf):
    """Whether detector and selector of the fixed policy may go on, and why not."""
    return _retro(spark, sf)["gates"]


@query("retrospective_intervals", f"""WITH {_RETRO} SELECT cohort, count(*)::BIGINT AS n, count(*) >= 5 AS has_interval, CASE WHEN count(*) >= 5 THEN true END AS holds_mean FROM y GROUP BY cohort""")
def retrospective_intervals(spark, sf):
    """Each cohort's interval of the answer delta: NULL below five cases, else around the mean."""
    c = _retro(spark, sf)["cohorts"]
    return c.select("cohort", big("n").alias("n"), F.col("ci_low").isNotNull().alias("has_interval"),
                    ((F.col("ci_low") <= F.col("mean_delta")) & (F.col("mean_delta") <= F.col("ci_high"))).alias("holds_mean"))


_HOLD = f"""{ev._LABELLED}, cd AS (SELECT case_id, CASE WHEN truth_fail THEN 'rare' ELSE 'control' END AS cohort, semantic_ok AND reference_relevance >= 0.1 AS ok FROM lab),
r AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY cohort ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(ok::INT) OVER (PARTITION BY cohort) AS total FROM cd),
hc AS (SELECT case_id, cohort, CASE WHEN ok THEN 'chosen' ELSE 'backfilled' END AS role, CASE WHEN total >= 24 THEN 'complete' ELSE 'inconclusive' END AS status FROM r WHERE before < 24)"""


def _holdout(spark, sf):
    l = ev.labelled(spark, sf)
    cand = l.select("case_id", F.col("case_id").alias("ord"), F.when(F.col("truth_fail"), "rare").otherwise("control").alias("cohort"),
                    F.when(F.col("truth_fail"), "FAIL").otherwise("PASS").alias("identity_truth"), F.col("semantic_ok").alias("eligible"), (F.col("reference_relevance") < 0.1).alias("contaminated"))
    i = F.col("case_id")
    refs = l.select("case_id", F.concat(F.lit("ref/"), (i % 7).cast("string")).alias("path"))
    reserve = l.select("case_id", F.concat(F.lit("ref/"), (i % 5).cast("string")).alias("path"))
    return studies.holdout(cand, refs, reserve, 24)


@query("holdout_cases", f"WITH {_HOLD} SELECT * FROM hc")
def holdout_cases(spark, sf):
    return _holdout(spark, sf)["cases"].select("case_id", "cohort", "role", "status")


@query("holdout_problems", f"""WITH {_HOLD} SELECT 'error' AS severity, 'reference_in_reserve' AS code, case_id::VARCHAR AS ident FROM hc WHERE role = 'chosen' AND case_id % 7 = case_id % 5
UNION ALL SELECT 'error', 'short_cohort', c FROM (VALUES ('rare'), ('control')) v(c) WHERE (SELECT count(*) FROM hc WHERE cohort = c AND role = 'chosen') <> 24""")
def holdout_problems(spark, sf):
    return _holdout(spark, sf)["problems"].select("severity", "code", "ident")


@query("run_report", f"""WITH {fl._BESTSEED} SELECT method, round(avg(dino), 6) AS dino, round(avg(siglip2), 6) AS siglip2, round(avg(attribute_accuracy), 6) AS attribute_accuracy FROM b WHERE rn = 1 GROUP BY method""")
def run_report(spark, sf):
    """Merged tables, best seed per cell and mean per method in one plan."""
    s = fl.scores(spark, sf)
    rep = studies.run_report(fl.plan(spark, sf), [s.select("image_id", "dino"), s.select("image_id", "siglip2", "attribute_accuracy")], ["dino", "siglip2", "attribute_accuracy"])
    return rep["means"].select("method", *[r(c).alias(c) for c in ("dino", "siglip2", "attribute_accuracy")])


@query("filtered_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def filtered_rows(spark, sf):
    return paired.where_equal(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="5-LOW").select("o_orderkey")


@query("target_buckets", """SELECT CASE WHEN n <= 4 THEN n::VARCHAR ELSE '5+' END AS bucket, count(*)::BIGINT AS n_concepts FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1""")
def target_buckets(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(consensus.target_bucket("n").alias("bucket")).agg(big(F.count(F.lit(1))).alias("n_concepts"))


@query("case_status", f"WITH {ev._CAND}, {ev._WINNER} SELECT case_id, CASE WHEN winner <> 0 THEN 'repaired' WHEN draft_ok THEN 'healthy' ELSE 'unrepaired' END AS status FROM w")
def case_status(spark, sf):
    c = ev.candidates(spark, sf)
    w = verdicts.select_winner(c).join(c.groupBy("case_id").agg(F.bool_or((F.col("attempt") == 0) & F.col("ok")).alias("draft_ok")), "case_id")
    return w.select("case_id", verdicts.status_for("draft_ok", "winner").alias("status"))


@query("annotation_records", f"""WITH {fl._PARTS}, n AS (SELECT image_id, count(DISTINCT part_group) AS n FROM pg WHERE visible GROUP BY 1), o AS (SELECT o_custkey AS species, o_orderkey AS image_id, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON n.image_id = o_orderkey),
s AS (SELECT species, count(*) AS n_images, arg_min(image_id, (-n, image_id)) AS source_image, max(n) AS n_crops FROM o GROUP BY species)
SELECT species, replace(c_name, '#', ' ') AS common_name, n_images::BIGINT AS n_images, source_image, n_crops::BIGINT AS n_crops FROM s JOIN customer ON c_custkey = species""")
def annotation_records(spark, sf):
    """Images, classes, boxes and points joined to one record per species, crops taken from its source image."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    images = o.select(F.col("o_custkey").alias("species"), F.col("o_orderkey").alias("image_id"))
    pts = fl.points(spark, sf)
    boxes = o.select(F.col("o_orderkey").alias("image_id"), F.lit(90.0).alias("box_w"), F.lit(60.0).alias("box_h"), F.lit(210).alias("width"), F.lit(120).alias("height"))
    src = files.source_images(images, pts)
    crops = files.group_crops(pts.join(src.select("image_id"), "image_id", "left_semi"), boxes).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_crops"))
    classes = c.select(F.col("c_custkey").alias("species"), names.common_name(F.concat(F.lit("1."), F.translate("c_name", "#", "_"))).alias("common_name"))
    n = images.groupBy("species").agg(F.count(F.lit(1)).alias("n_images"))
    j = n.join(src, "species").join(classes, "species").join(crops, "image_id", "left")
    return j.select("species", "common_name", big("n_images").alias("n_images"), F.col("image_id").alias("source_image"), big(F.coalesce("n_crops", F.lit(0))).alias("n_crops"))


@query("attribute_reshape", f"""WITH {_READS} SELECT concept, slot, value, support::BIGINT AS support, 'vision' AS source FROM tgt WHERE support * 3 >= visible_count""")
def attribute_reshape(spark, sf):
    """Target slots of a consensus map kept and given their source."""
    t = consensus.target_attributes(reads(spark, sf)).withColumn("is_target", F.col("support") * 3 >= F.col("visible_count"))
    # one entry per slot: bounded by the slot vocabulary
    m = t.groupBy("concept").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("value", "support", "visible_count", "is_target")))).alias("a"))
    kept = m.select("concept", F.explode(names.target_attributes_map("a", "vision")).alias("slot", "v"))
    return kept.select("concept", "slot", "v.value", big("v.support").alias("support"), "v.source")


@query("part_attribute_map", f"""WITH {fl._GRAPH_ATTR} SELECT DISTINCT concept, part || '.' || attr AS key FROM attrs WHERE lower(trim(value)) <> 'not visible'""")
def part_attribute_map(spark, sf):
    g = fl.concept_graphs(spark, sf)
    return g.select("concept", F.explode(F.map_keys(names.part_attributes_map("parts"))).alias("key"))


@query("edit_prompts", """SELECT p_partkey, 'Replace only the ' || p_type || ' with a ' || p_name || '. Preserve its pose, position, scale, viewpoint, lighting and shadows, and preserve the surrounding scene. Use the reference image only for the defining visual identity of the ' || p_name
 || '; do not copy its background, text, people, framing or artistic style. The result must still depict: ' || p_brand || '.' AS prompt FROM part""")
def edit_prompts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.edit_prompt("p_brand", "p_type", "p_name").alias("prompt"))


# --- user functions: deterministic stand-ins for models -------------------------------------------

def hash_vectors(texts):
    return np.array([np.frombuffer(hashlib.sha256(str(t).encode()).digest(), dtype=np.uint8)[:16].astype(float) + 1 for t in texts]).reshape(len(texts), 16)


@query("embedded_documents", """WITH b AS (SELECT doc_id, list_transform(range(16), lambda i: (('0x' || substring(sha256(text), 2 * i + 1, 2))::INT + 1)::DOUBLE) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS len FROM b)
SELECT doc_id, round(v[1] / len, 6) AS v0, round(sqrt(list_sum(list_transform(v, lambda x: (x / len) * (x / len)))), 6) AS norm FROM n""")
def embedded_documents(spark, sf):
    """Batch embedding of whole texts by a stand-in function."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    v = udf.embed_items(d, "doc_id", "text", hash_vectors, 16)
    return v.select("doc_id", r(F.get("vec", F.lit(0))).alias("v0"), r(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))


@query("memoised_reads", "SELECT l_orderkey, l_linenumber, upper(l_returnflag) || '!' AS reply FROM lineitem")
def memoised_reads(spark, sf):
    """A reader called once per distinct input and joined back to every row."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("path"))
    return udf.read_attributes(li, "path", lambda xs: [x.upper() + "!" for x in xs]).select("l_orderkey", "l_linenumber", "reply")


@query("judged_pairs", """SELECT c_custkey, c_mktsegment AS x, n_name AS y, length(c_mktsegment) = length(n_name) AS match FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def judged_pairs(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.select("c_custkey", F.col("c_mktsegment").alias("x"), F.col("n_name").alias("y"), F.lit("name").alias("slot"))
    return udf.judge_equivalence(j, lambda xs, ys, slots: [len(a) == len(b) for a, b in zip(xs, ys)]).select("c_custkey", "x", "y", "match")


@query("scored_pairs", """SELECT s_suppkey, length(s_name)::DOUBLE / length(n_name) AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def scored_pairs(spark, sf):
    j = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return udf.score_pairs(j, "s_name", "n_name", lambda a, b: [len(x) / len(y) for x, y in zip(a, b)]).select("s_suppkey", "score")


@query("retrieved_prototypes")
def retrieved_prototypes(spark, sf):
    """Prototypes of phrases from their nearest corpus items, text vectors coming from a stand-in function."""
    c = concept_list(spark).select(F.col("concept").alias("phrase"), F.lit("thing").alias("coarse"))
    q = studies.phrase_queries(c)
    vec64 = lambda texts: np.tile(hash_vectors(texts), (1, 4)) - 128.0
    embedded = udf.embed_items(q, "query", "query", vec64, 64)
    corpus = items(spark, sf).select(F.col("id").alias("doc_id"), "vec")
    p = studies.retrieved_prototypes(c, embedded, corpus)
    return p.select("phrase", r(F.get("centroid", F.lit(0))).alias("c0"))
