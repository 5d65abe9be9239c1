"""Consensus, prediction, store and pair-protocol queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.catalog.base import ITEMS, big, items, query, r, table
from sorrel.operators import consensus, verdicts
from sorrel.session import cut
from sorrel.sources import graphs, store

# --- consensus: concept = nation, reads = customers -----------------------------------------

_BAND = "CASE WHEN c_acctbal < 1000 THEN 'Not Visible' WHEN c_acctbal < 4000 THEN ' Low' WHEN c_acctbal < 7000 THEN 'mid ' ELSE 'HIGH' END"
_READS = f"""reads AS (SELECT c_nationkey AS concept, c_custkey AS ord, 'segment' AS slot, c_mktsegment AS value FROM customer
 UNION ALL SELECT c_nationkey, c_custkey, 'band', {_BAND} FROM customer),
vis AS (SELECT concept, ord, slot, lower(trim(value)) AS value FROM reads WHERE lower(trim(value)) NOT IN ('not visible', 'none', 'n/a', '')),
cnt AS (SELECT concept, slot, value, count(*) AS n, min(ord) AS f FROM vis GROUP BY concept, slot, value),
tgt AS (SELECT concept, slot, arg_min(value, (-n, f)) AS value, max(n) AS support, sum(n) AS visible_count, max(n) >= greatest(2, ceil(sum(n) / 2)) AND sum(n) >= 3 AS is_target FROM cnt GROUP BY concept, slot)"""


def reads(spark, sf):
    c = table(spark, sf, "customer")
    b = F.col("c_acctbal")
    band = F.when(b < 1000, "Not Visible").when(b < 4000, " Low").when(b < 7000, "mid ").otherwise("HIGH")
    slots = F.array(F.struct(F.lit("segment").alias("slot"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("band").alias("slot"), band.alias("value")))
    return c.select(F.col("c_nationkey").alias("concept"), F.col("c_custkey").alias("ord"), F.explode(slots).alias("_s")).select("concept", "ord", "_s.slot", "_s.value")


@query("consensus_attributes", f"WITH {_READS} SELECT concept, slot, value, support::BIGINT AS support, visible_count::BIGINT AS visible_count, is_target FROM tgt")
def consensus_attributes(spark, sf):
    t = consensus.target_attributes(reads(spark, sf))
    return t.select("concept", "slot", "value", big("support").alias("support"), big("visible_count").alias("visible_count"), "is_target")


@query("decidable_concepts", f"""WITH {_READS}, d AS (SELECT concept, count(*) FILTER (is_target) AS n FROM tgt GROUP BY concept)
SELECT n_regionkey AS cohort, count(*) FILTER (n >= 2)::BIGINT AS n_decidable, count(*) FILTER (n < 2)::BIGINT AS n_undecidable FROM d JOIN nation ON n_nationkey = concept GROUP BY n_regionkey""")
def decidable_concepts(spark, sf):
    cohorts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept"), F.col("n_regionkey").alias("cohort"))
    f = consensus.feasibility(consensus.target_attributes(reads(spark, sf)), cohorts)
    return f.select("cohort", big("n_decidable").alias("n_decidable"), big("n_undecidable").alias("n_undecidable"))


@query("strict_majority", f"""WITH {_READS}, k AS (SELECT *, row_number() OVER (PARTITION BY concept, slot ORDER BY n DESC, value) AS rn, lead(n) OVER (PARTITION BY concept, slot ORDER BY n DESC, value) AS nx FROM cnt)
SELECT concept, slot, value, n::BIGINT AS votes FROM k WHERE rn = 1 AND (nx IS NULL OR n > nx)""")
def strict_majority(spark, sf):
    m = consensus.strict_majority(reads(spark, sf), ["concept", "slot"])
    return m.select("concept", "slot", "value", big("votes").alias("votes"))


@query("heldout_labels", """WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1), f AS (SELECT l_partkey AS concept, l_orderkey, min(lower(l_returnflag)) AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b) GROUP BY 1, 2),
c AS (SELECT concept, value, count(*) AS n FROM f GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY n DESC, value) AS rn, lead(n) OVER (PARTITION BY concept ORDER BY n DESC, value) AS nx FROM c)
SELECT concept, value, n::BIGINT AS votes FROM k WHERE rn = 1 AND (nx IS NULL OR n > nx)""")
def heldout_labels(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_partkey").alias("concept"), F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("value"))
    build = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("path"))
    return consensus.heldout_labels(rows, build, ["concept"]).select("concept", "value", big("votes").alias("votes"))


# --- predictions: concept = four vectors, attributes = majority of a user's events ------------

_ATTRS = f"""{ITEMS}, vc AS (SELECT id // 4 AS concept, id % 4 AS part, vec FROM items),
ev AS (SELECT user_id AS concept, (event_id % 8) // 2 AS part, event_id % 2 AS half, event_type AS value, count(*) AS n FROM events GROUP BY ALL),
mj AS (SELECT *, row_number() OVER (PARTITION BY concept, part, half ORDER BY n DESC, value) AS rn, lead(n) OVER (PARTITION BY concept, part, half ORDER BY n DESC, value) AS nx FROM ev),
won AS (SELECT concept, part, half, 'p' || part AS slot, value, concept % 5 AS family FROM mj WHERE rn = 1 AND (nx IS NULL OR n > nx)),
attrs AS (SELECT * FROM won WHERE half = 0), labs AS (SELECT * FROM won WHERE half = 1),
sib AS (SELECT a.concept, a.slot, a.part, b.concept AS o, b.value FROM attrs a JOIN attrs b ON a.slot = b.slot AND a.family = b.family AND a.concept <> b.concept),
sc AS (SELECT concept, slot, part, value, count(*) AS n FROM sib GROUP BY ALL), tp AS (SELECT *, max(n) OVER (PARTITION BY concept, slot) AS top FROM sc),
ti AS (SELECT * FROM tp WHERE n = top), nt AS (SELECT concept, slot, count(*) AS k, min(value) AS low FROM ti GROUP BY ALL),
nr AS (SELECT ti.concept, ti.slot, arg_min(ti.value, (-list_inner_product(q.vec, d.vec), s.o)) AS near FROM ti JOIN sib s ON s.concept = ti.concept AND s.slot = ti.slot AND s.value = ti.value
 JOIN vc q ON q.concept = ti.concept AND q.part = ti.part JOIN vc d ON d.concept = s.o AND d.part = ti.part GROUP BY ALL),
fam AS (SELECT nt.concept, nt.slot, CASE WHEN k = 1 THEN low ELSE coalesce(near, low) END AS prediction FROM nt LEFT JOIN nr USING (concept, slot)),
nn AS (SELECT q.concept, a.slot, arg_min(a.value, (-list_inner_product(q.vec, d.vec), a.concept)) AS prediction FROM vc q JOIN attrs a ON a.part = q.part AND a.concept <> q.concept JOIN vc d ON d.concept = a.concept AND d.part = a.part GROUP BY ALL),
rare AS (SELECT slot, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY slot) AS n_visible FROM labs GROUP BY slot, value),
rr AS (SELECT * FROM rare WHERE n <= greatest(2, ceil(0.15 * n_visible))),
cases AS (SELECT l.concept, l.slot, l.value, nn.prediction AS pred_retrieval, fam.prediction AS pred_graph, rr.value IS NOT NULL AS rare FROM labs l JOIN nn USING (concept, slot) JOIN fam USING (concept, slot) LEFT JOIN rr ON rr.slot = l.slot AND rr.value = l.value)"""


def predictions(spark, sf):
    it = items(spark, sf)
    vectors = it.select(F.floor(F.col("id") / 4).alias("concept"), (F.col("id") % 4).alias("part"), "vec")
    e = table(spark, sf, "events").select(F.col("user_id").alias("concept"), F.floor(F.col("event_id") % 8 / 2).alias("part"), (F.col("event_id") % 2).alias("half"), F.col("event_type").alias("value"))
    won = cut(consensus.strict_majority(e, ["concept", "part", "half"]).select(
        "concept", "part", "half", F.concat(F.lit("p"), F.col("part").cast("string")).alias("slot"), "value", (F.col("concept") % 5).alias("family")))
    return vectors, won.where("half = 0"), won.where("half = 1")


@query("family_majority", f"WITH {_ATTRS} SELECT * FROM fam")
def family_majority(spark, sf):
    vectors, attrs, _ = predictions(spark, sf)
    return consensus.family_majority(attrs, vectors)


@query("neighbour_prediction", f"WITH {_ATTRS} SELECT * FROM nn")
def neighbour_prediction(spark, sf):
    vectors, attrs, _ = predictions(spark, sf)
    return consensus.neighbour_prediction(vectors, attrs)


@query("rare_values", f"WITH {_ATTRS} SELECT slot, value, n::BIGINT AS n, n_visible::BIGINT AS n_visible FROM rr")
def rare_values(spark, sf):
    _, _, labels = predictions(spark, sf)
    return consensus.rare_values(labels).select("slot", "value", big("n").alias("n"), big("n_visible").alias("n_visible"))


@query("two_arm_cases", f"WITH {_ATTRS} SELECT * FROM cases")
def two_arm_cases(spark, sf):
    return _two_arms(spark, sf).select("concept", "slot", "value", "pred_retrieval", "pred_graph", "rare")


def _two_arms(spark, sf):
    vectors, attrs, labels = predictions(spark, sf)
    return consensus.two_arm_cases(labels.select("concept", "slot", "value"), consensus.neighbour_prediction(vectors, attrs), consensus.family_majority(attrs, vectors))


@query("two_arm_report", f"""WITH {_ATTRS}, m AS (SELECT rare, value = pred_retrieval AS a, value = pred_graph AS b FROM cases),
t AS (SELECT count(*) FILTER (rare) AS nr, count(*) FILTER (rare AND b AND NOT a) AS g, count(*) FILTER (rare AND a AND NOT b) AS h FROM m),
pv AS (SELECT coalesce(least(1, 2 * sum(exp(lgamma(g + h + 1) - lgamma(i + 1) - lgamma(g + h - i + 1) - (g + h) * ln(2)))), 1) AS p FROM (SELECT g, h, unnest(range(0, least(g, h) + 1)) AS i FROM t))
SELECT count(*) FILTER (rare)::BIGINT AS n_rare, count(*)::BIGINT AS n_total, round(avg(b::INT) FILTER (NOT rare), 9) AS common_recall_graph, round(avg(a::INT) FILTER (NOT rare), 9) AS common_recall_retrieval,
 round(avg(b::INT) FILTER (rare), 9) AS rare_recall_graph, round(avg(a::INT) FILTER (rare), 9) AS rare_recall_retrieval, round(avg(b::INT) FILTER (rare) - avg(a::INT) FILTER (rare), 9) AS delta, (SELECT round(p, 9) FROM pv) AS mcnemar_p,
 count(*) FILTER (rare AND b AND NOT a)::BIGINT AS graph_only, count(*) FILTER (rare AND a AND NOT b)::BIGINT AS retrieval_only,
 (SELECT CASE WHEN nr >= 30 AND (g - h) / nr::DOUBLE >= 0.15 AND p < 0.05 THEN 'PASS' ELSE 'WIND_DOWN' END FROM t, pv) AS decision FROM m""")
def two_arm_report(spark, sf):
    scored = _two_arms(spark, sf).withColumn("match_retrieval", F.col("value") == F.col("pred_retrieval")).withColumn("match_graph", F.col("value") == F.col("pred_graph"))
    t = consensus.two_arm_report(scored)
    return t.select(big("n_rare").alias("n_rare"), big("n_total").alias("n_total"), r("common_recall_graph", 9).alias("common_recall_graph"), r("common_recall_retrieval", 9).alias("common_recall_retrieval"),
                    *[F.when(~F.isnan(c), r(c, 9)).alias(c) for c in ("rare_recall_graph", "rare_recall_retrieval", "delta")], r("mcnemar_p", 9).alias("mcnemar_p"),
                    big("graph_only").alias("graph_only"), big("retrieval_only").alias("retrieval_only"), "decision")


@query("rare_feasibility", f"""WITH {_ATTRS} SELECT CASE WHEN grouping(slot) = 1 THEN 'all' ELSE slot END AS slot, count(*)::BIGINT AS n_included, count(*) FILTER (rare)::BIGINT AS n_rare FROM cases GROUP BY GROUPING SETS ((), (slot))""")
def rare_feasibility(spark, sf):
    f = consensus.rare_feasibility(_two_arms(spark, sf))
    return f.select(F.coalesce("slot", F.lit("all")).alias("slot"), big("n_included").alias("n_included"), big("n_rare").alias("n_rare"))


@query("mcnemar", """WITH b AS (SELECT event_type, count(*) FILTER (value > 60 AND user_id % 10 = 0)::BIGINT AS b, count(*) FILTER (value > 60 AND user_id % 10 = 1)::BIGINT AS c FROM events GROUP BY event_type),
i AS (SELECT event_type, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM b), l AS (SELECT event_type, b, c, i, (lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) AS lp FROM i)
SELECT event_type, b, c, round(least(1, 2 * sum(exp(lp))), 6) AS p FROM l GROUP BY event_type, b, c""")
def mcnemar(spark, sf):
    from sorrel.functions.scores import binomial_two_sided

    hit = lambda d: F.count_if((F.col("value") > 60) & (F.col("user_id") % 10 == d))
    b = table(spark, sf, "events").groupBy("event_type").agg(big(hit(0)).alias("b"), big(hit(1)).alias("c"))
    return b.select("event_type", "b", "c", r(binomial_two_sided("b", "c")).alias("p"))


# --- attribute verdicts ------------------------------------------------------------------------

_JUDGE = """seg AS (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer), jd AS (SELECT x.s AS x, y.s AS y, 'segment' AS slot, length(x.s) >= length(y.s) AND length(y.s) >= length(x.s) AS match FROM seg x, seg y WHERE x.s <> y.s)"""


def judged(spark, sf):
    s = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("x")).distinct()
    # the few distinct values meet each other once through a shared key
    pairs = s.withColumn("slot", F.lit("segment")).join(s.select(F.col("x").alias("y"), F.lit("segment").alias("slot")), "slot").where("x <> y")
    replies = pairs.withColumn("reply", F.when(F.length("x") >= F.length("y"), " Yes, the same").otherwise("No"))
    return consensus.judge_both_ways(replies)


@query("judge_both_ways", f"WITH {_JUDGE} SELECT * FROM jd")
def judge_both_ways(spark, sf):
    return judged(spark, sf)


_PROTOCOL = f"""{_READS}, {_JUDGE}, dec AS (SELECT concept, count(*) FILTER (is_target) AS n FROM tgt GROUP BY concept),
prof AS (SELECT concept, slot, value, true AS is_target FROM tgt),
sb AS (SELECT a.n_nationkey AS id, b.n_nationkey AS sibling, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY abs(a.n_nationkey - b.n_nationkey), b.n_nationkey) AS rn FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
tests AS (SELECT s_suppkey AS item, s_nationkey AS id, CASE WHEN s_acctbal < 1000 THEN 'none' WHEN s_acctbal < 4000 THEN 'low' WHEN s_acctbal < 7000 THEN 'Mid' ELSE 'high' END AS band,
 CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'n/a' END AS segment FROM supplier),
pr AS (SELECT item, id, id AS candidate, 'pass' AS label FROM tests UNION ALL SELECT item, t.id, sibling, 'fail' FROM tests t JOIN sb ON sb.id = t.id AND rn <= 3),
rd AS (SELECT item, 'band' AS slot, band AS read FROM tests UNION ALL SELECT item, 'segment', segment FROM tests),
st AS (SELECT pr.item, pr.id, candidate, label, p.slot, p.value AS target, coalesce(lower(trim(rd.read)), 'not visible') AS read FROM pr JOIN prof p ON p.concept = pr.candidate LEFT JOIN rd ON rd.item = pr.item AND rd.slot = p.slot),
s2 AS (SELECT st.*, read NOT IN ('not visible', 'none', 'n/a', '') AS present, target = read OR coalesce(jd.match, false) AS same FROM st LEFT JOIN jd ON jd.x = target AND jd.y = read AND jd.slot = st.slot),
vd AS (SELECT item, id, candidate, label, count(*) FILTER (present) AS n_present, count(*) FILTER (present AND NOT same) AS n_contradicted FROM s2 GROUP BY ALL)"""


@query("nearest_siblings", """SELECT id, sibling, rn::BIGINT AS rank FROM (SELECT a.p_partkey AS id, b.p_partkey AS sibling, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_partkey - b.p_partkey), b.p_partkey) AS rn
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE rn <= 3""")
def nearest_siblings(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"))
    return consensus.nearest_siblings(p).select("id", "sibling", big("rank").alias("rank"))


@query("discrimination_verdicts", f"""WITH {_PROTOCOL} SELECT item, id, candidate, label, n_present::BIGINT AS n_present, n_contradicted::BIGINT AS n_contradicted,
 CASE WHEN n_present = 0 THEN 'ABSTAIN' WHEN n_contradicted > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM vd""")
def discrimination_verdicts(spark, sf):
    """Every test item against its own profile and its nearest siblings' profiles.

    All slots count as targets here, so that profiles of this data are decidable.
    """
    return _discrimination(spark, sf)


def _discrimination(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("family"))
    targets = consensus.target_attributes(reads(spark, sf)).withColumn("is_target", F.lit(True))
    profiles = consensus.decidable(targets).withColumnRenamed("concept", "id")
    b = F.col("s_acctbal")
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("id"), F.when(b < 1000, "none").when(b < 4000, "low").when(b < 7000, "Mid").otherwise("high").alias("band"),
        F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "MACHINERY").otherwise("n/a").alias("segment"))
    pairs = consensus.discrimination_pairs(s.select("item", "id"), consensus.nearest_siblings(nation).select("id", "sibling"), profiles)
    slots = F.array(*[F.struct(F.lit(n).alias("slot"), F.col(n).alias("value")) for n in ("band", "segment")])
    item_reads = s.select("item", F.explode(slots).alias("_s")).select("item", "_s.*")
    case = ["item", "id", "candidate", "label"]
    case_targets = pairs.join(targets.withColumnRenamed("concept", "candidate"), "candidate")
    case_reads = pairs.join(item_reads, "item")
    states = consensus.attribute_states(case_targets, case_reads, judged(spark, sf), case)
    cases = pairs.join(profiles.select(F.col("id").alias("candidate"), "n_targets"), "candidate")
    v = consensus.case_verdicts(cases, states, case=case)
    return v.select(*case, big("n_present").alias("n_present"), big("n_contradicted").alias("n_contradicted"), "verdict")


@query("discrimination_gate", f"""WITH {_PROTOCOL}, v AS (SELECT label, n_present > 0 AND n_contradicted > 0 AS fail, n_present = 0 AS abst FROM vd)
SELECT count(*) FILTER (label = 'fail' AND fail)::BIGINT AS tp, count(*) FILTER (label = 'pass' AND fail)::BIGINT AS fp, round(avg(fail::INT) FILTER (label = 'fail'), 9) AS recall, round(avg(fail::INT) FILTER (label = 'pass'), 9) AS fp_rate, count(*) FILTER (abst)::BIGINT AS n_abstain FROM v""")
def discrimination_gate(spark, sf):
    c = verdicts.three_way_confusion(_discrimination(spark, sf))
    return c.select(big("tp").alias("tp"), big("fp").alias("fp"), r("recall", 9).alias("recall"), r("fp_rate", 9).alias("fp_rate"), big("n_abstain").alias("n_abstain"))


@query("family_accumulate", """WITH f AS (SELECT p_brand || '/' || p_type || '/' || (p_size // 9) AS family, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT p_partkey AS id, r.family FROM part JOIN r ON r.family = p_brand || '/' || p_type || '/' || (p_size // 9) WHERE before < 150""")
def family_accumulate(spark, sf):
    fam = F.concat_ws("/", "p_brand", "p_type", F.floor(F.col("p_size") / 9).cast("string"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), fam.alias("family"))
    return consensus.whole_families(p, 3, 150).select("id", "family")


@query("arm_divergence", """WITH f AS (SELECT l_suppkey AS concept, l_partkey AS path, max(l_quantity) AS fs FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), g AS (SELECT l_suppkey AS concept, l_partkey AS path, max(l_extendedprice) AS gs FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
b AS (SELECT coalesce(f.concept, g.concept) AS concept, coalesce(f.path, g.path) AS path, fs, gs FROM f FULL JOIN g ON f.concept = g.concept AND f.path = g.path),
t AS (SELECT concept, count(fs) AS n_flat, count(gs) AS n_graph, count(*) FILTER (fs IS NOT NULL AND gs IS NOT NULL) / count(*)::DOUBLE AS jac, arg_min(path, (-fs, path)) FILTER (fs IS NOT NULL) AS ft, arg_min(path, (-gs, path)) FILTER (gs IS NOT NULL) AS gt,
 arg_min(gs IS NOT NULL, (-fs, path)) FILTER (fs IS NOT NULL) AS fg FROM b GROUP BY concept), p AS (SELECT l_suppkey AS concept, count(DISTINCT l_linenumber) AS np FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT t.concept, n_flat::BIGINT AS n_flat, n_graph::BIGINT AS n_graph, round(jac, 9) AS jaccard, coalesce(ft = gt, false) AS same_top, coalesce(np, 0)::BIGINT AS n_part_types, coalesce(fg, false) AS flat_top_in_graph FROM t LEFT JOIN p USING (concept)""")
def arm_divergence(spark, sf):
    li = table(spark, sf, "lineitem")
    flat = li.where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("concept"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("score"))
    graph = li.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("concept"), F.col("l_partkey").alias("path"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("part_type"))
    d = consensus.arm_divergence(flat, graph)
    return d.select("concept", big("n_flat").alias("n_flat"), big("n_graph").alias("n_graph"), r("jaccard", 9).alias("jaccard"), "same_top", big("n_part_types").alias("n_part_types"), "flat_top_in_graph")


@query("part_representatives", """SELECT l_suppkey AS concept, l_linenumber AS part_type, arg_min(l_partkey, (-l_extendedprice, l_partkey)) AS path, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2""")
def part_representatives(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("concept"), F.col("l_linenumber").alias("part_type"), F.col("l_partkey").alias("path"), F.col("l_extendedprice").alias("score"))
    return consensus.part_representatives(g)


@query("checklist_accuracy", """SELECT p_brand, round(coalesce(avg((p_retailprice > 1000)::INT) FILTER (p_size < 3), 1), 9) AS accuracy FROM part GROUP BY p_brand""")
def checklist_accuracy(spark, sf):
    yes = F.when(F.col("p_size") < 3, F.col("p_retailprice") > 1000)
    return table(spark, sf, "part").groupBy("p_brand").agg(r(consensus.checklist_accuracy(yes), 9).alias("accuracy"))


# --- taxonomy and store: species = nation, items = vectors by label -------------------------------

@query("taxonomy_dimension", """WITH f AS (SELECT p_partkey AS species, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand || ' ' || p_type END AS family FROM part)
SELECT species, family, CASE WHEN family IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY family) - 1 - (SELECT max((family IS NULL)::INT) FROM f) * 0 END::BIGINT AS family_id FROM f WHERE family IS NOT NULL UNION ALL SELECT species, NULL, NULL FROM f WHERE family IS NULL""")
def taxonomy_dimension(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("species"), F.when(F.col("p_size") % 10 != 0, F.concat_ws(" ", "p_brand", "p_type")).alias("family"))
    return graphs.taxonomy_dimension(p).select("species", "family", "family_id")


@query("multi_member_families", """SELECT p_brand || ' ' || p_type || ' ' || p_size AS family, count(*)::BIGINT AS n_members FROM part GROUP BY 1 HAVING count(*) >= 2""")
def multi_member_families(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("family"))
    return graphs.multi_member_families(p).select("family", big("n_members").alias("n_members"))


def store_tables(spark, sf):
    """Species are the nations; their items the vectors of their label, their attributes the consensus."""
    n = table(spark, sf, "nation")
    ds = F.when(F.col("n_regionkey") < 2, "north").otherwise("south")
    ids = n.select("n_nationkey", F.concat_ws(":", ds, F.col("n_name")).alias("global_id"), "n_name", "n_regionkey")
    species = ids.select("global_id", F.col("n_name").alias("scientific_name"), F.lit(None).cast("string").alias("common_name"),
                         F.create_map(F.lit("family"), F.col("n_regionkey").cast("string")).alias("taxonomy"),
                         F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("provenance"))
    it = items(spark, sf).join(ids, F.col("concept") == F.col("n_nationkey"))
    item = it.select("global_id", F.col("id").alias("ref"), F.concat(F.lit("img/"), F.col("id").cast("string")).alias("path"),
                     F.when(F.col("part") < 3, F.concat(F.lit("t"), F.col("part").cast("string"))).alias("part"), F.col("id").alias("ord"), "vec")
    t = consensus.target_attributes(reads(spark, sf)).join(ids.withColumnRenamed("n_nationkey", "concept"), "concept")
    attrs = t.select("global_id", "slot", "value", F.col("support").cast("int").alias("support"), F.col("visible_count").cast("int").alias("visible_count"), F.lit("consensus").alias("source"))
    rel = ids.select("global_id", F.lit("instance_of").alias("type"), F.concat(F.lit("family:"), F.col("n_regionkey").cast("string")).alias("target"))
    return store.build_records(species, item, attrs, rel)


_STORE = f"""{_READS}, {ITEMS}, sp AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey < 2 THEN 'north' ELSE 'south' END || ':' || n_name AS global_id, CASE WHEN n_regionkey < 2 THEN 'north' ELSE 'south' END AS dataset, n_regionkey FROM nation),
rec AS (SELECT * FROM sp WHERE k IN (SELECT concept FROM items)),
po AS (SELECT 'attribute' AS index, slot || '|' || value AS key, global_id, NULL::BIGINT AS ref FROM rec JOIN tgt ON tgt.concept = rec.k UNION ALL SELECT 'hub', 'family:' || n_regionkey, global_id, NULL FROM rec
 UNION ALL SELECT 'part', 't' || part, global_id, min(id) FROM rec JOIN items ON items.concept = rec.k WHERE part < 3 GROUP BY part, global_id)"""


@query("store_postings", f"WITH {_STORE} SELECT * FROM po")
def store_postings(spark, sf):
    return store_tables(spark, sf)["posting"]


@query("store_skipped", f"WITH {_STORE} SELECT global_id, 'no items' AS reason FROM sp WHERE k NOT IN (SELECT concept FROM items)")
def store_skipped(spark, sf):
    return store_tables(spark, sf)["skipped"]


@query("store_lookup", f"""WITH {_STORE} SELECT DISTINCT global_id FROM po WHERE index = 'hub' AND key = 'family:1' INTERSECT SELECT global_id FROM po WHERE index = 'part' AND key = 't2'""")
def store_lookup(spark, sf):
    t = store_tables(spark, sf)
    return store.lookup(t["posting"], t["record"], hub="family:1", part_type="t2")


@query("hub_members", f"WITH {_STORE} SELECT global_id FROM po WHERE index = 'hub' AND key = 'family:2'")
def hub_members(spark, sf):
    return store.members(store_tables(spark, sf)["posting"], "family:2")


@query("hub_sizes", f"WITH {_STORE} SELECT key, count(*)::BIGINT AS n_members FROM po WHERE index = 'hub' GROUP BY key")
def hub_sizes(spark, sf):
    return store.hub_sizes(store_tables(spark, sf)["posting"]).select("key", big("n_members").alias("n_members"))


@query("store_summary", f"""WITH {_STORE}, a AS (SELECT concept, count(*) AS slots FROM tgt GROUP BY concept), i AS (SELECT concept, count(*) AS cand, count(DISTINCT CASE WHEN part < 3 THEN part END) AS crops FROM items GROUP BY concept)
SELECT dataset, count(*)::BIGINT AS n_species, count(*) FILTER (slots > 0)::BIGINT AS species_with_attributes, coalesce(sum(slots), 0)::BIGINT AS attribute_slots, count(*)::BIGINT AS n_medoids, sum(crops)::BIGINT AS n_crops, sum(cand)::BIGINT AS n_candidates
FROM rec LEFT JOIN a ON a.concept = rec.k JOIN i ON i.concept = rec.k GROUP BY dataset""")
def store_summary(spark, sf):
    s = store.summary(store_tables(spark, sf))
    return s.select("dataset", *[big(c).alias(c) for c in ("n_species", "species_with_attributes", "attribute_slots", "n_medoids", "n_crops", "n_candidates")])


@query("store_round_trip", f"""WITH {_STORE}, sl AS (SELECT concept, count(DISTINCT slot)::BIGINT AS n, max(value) FILTER (slot = 'segment') AS segment FROM tgt GROUP BY concept),
li AS (SELECT concept, array_to_string(list('img/' || id ORDER BY id), ' ') AS candidates FROM items GROUP BY concept),
cr AS (SELECT concept, array_to_string(list('t' || part || '=' || id ORDER BY part), ' ') AS crops FROM (SELECT concept, part, min(id) AS id FROM items WHERE part < 3 GROUP BY concept, part) GROUP BY concept),
mp AS (SELECT concept, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM items), mm AS (SELECT concept, pos, avg(x) AS x FROM mp GROUP BY ALL), mv AS (SELECT concept, list(x ORDER BY pos) AS mean FROM mm GROUP BY concept),
md AS (SELECT concept, first(id ORDER BY list_cosine_similarity(vec, mean) DESC, id) AS medoid FROM items JOIN mv USING (concept) GROUP BY concept)
SELECT rec.global_id, dataset, coalesce(sl.n, 0) AS n_attributes, segment, 'nation ' || rec.k AS provenance, md.medoid, candidates, crops, 'instance_of family:' || n_regionkey AS relations
FROM rec LEFT JOIN sl ON sl.concept = rec.k JOIN li ON li.concept = rec.k LEFT JOIN cr ON cr.concept = rec.k JOIN md ON md.concept = rec.k""")
def store_round_trip(spark, sf):
    """Store written to the shared folder, read back with its stamp checked, records fetched by id."""
    from sorrel.session import scratch_path

    path = scratch_path(spark, "store")
    store.write_store(store_tables(spark, sf), path, "demo", 64)
    t = store.read_store(spark, path, "demo", 64)
    rec = store.get_records(t, t["record"].select("global_id"))
    joined = lambda column, one: F.concat_ws(" ", F.transform(column, one))
    return rec.select(
        "global_id", "dataset", big(F.coalesce(F.size("attributes"), F.lit(0))).alias("n_attributes"), F.try_element_at("attributes", F.lit("segment"))["value"].alias("segment"),
        "provenance", F.col("medoid.ref").alias("medoid"), joined("candidates", lambda x: x["path"]).alias("candidates"),
        joined("part_crops", lambda x: F.concat(x["part_type"], F.lit("="), x["ref"].cast("string"))).alias("crops"),
        joined("relations", lambda x: F.concat_ws(" ", x["type"], x["target"])).alias("relations"))


@query("nearest_crops", f"""WITH {_STORE}, c AS (SELECT items.* FROM items JOIN rec ON rec.k = items.concept WHERE n_regionkey = 1 AND id IN (SELECT ref FROM po WHERE index = 'part' AND key = 't1')),
x AS (SELECT q.id AS query_id, c.id AS ref, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.vec, c.vec) DESC, c.id) - 1 AS rank FROM items q, c)
SELECT query_id, ref, rank::BIGINT AS rank FROM x WHERE rank < 3""")
def nearest_crops(spark, sf):
    t = store_tables(spark, sf)
    q = items(spark, sf).select(F.col("id").alias("query_id"), "vec")
    return store.nearest_crops(t, q, 3, part_type="t1", hub="family:1").select("query_id", "ref", big("rank").alias("rank"))


@query("part_images", f"WITH {_STORE} SELECT global_id, key AS part_type, 'img/' || ref AS path FROM po WHERE index = 'part' AND key <> 't0'")
def part_images(spark, sf):
    t = store_tables(spark, sf)
    return store.part_images(t["item"], t["record"].select("global_id"), ["t1", "t2"])


@query("vector_table", f"WITH {ITEMS} SELECT row_number() OVER (ORDER BY id) - 1 AS ref, id, 'candidate' AS kind, round(1.0, 6) AS norm FROM items")
def vector_table(spark, sf):
    """Dense integer refs over unit vectors."""
    v = store.build_vectors(items(spark, sf), "id", "vec")
    return v.select(big("ref").alias("ref"), "id", "kind", r("norm").alias("norm"))


@query("prototype_bank", f"""WITH {ITEMS}, ph AS (SELECT DISTINCT n_nationkey AS phrase FROM nation), keep AS (SELECT * FROM items WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
long AS (SELECT concept, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM keep), m AS (SELECT concept, pos, avg(x) AS x FROM long GROUP BY concept, pos), nm AS (SELECT concept, sqrt(sum(x * x)) AS n FROM m GROUP BY concept)
SELECT phrase, round(m.x / n, 6) AS c0 FROM ph LEFT JOIN m ON m.concept = phrase AND pos = 1 LEFT JOIN nm USING (concept)""")
def prototype_bank(spark, sf):
    """Phrase to prototype vector, NULL for unknown phrases; excluded references are left out."""
    from sorrel.operators.groups import centroids

    bad = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    bank = centroids(items(spark, sf).join(bad, "id", "left_anti"), ["concept"])
    phrases = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("phrase")).distinct()
    return phrases.join(bank, F.col("phrase") == F.col("concept"), "left").select("phrase", r(F.get("centroid", F.lit(0))).alias("c0"))
