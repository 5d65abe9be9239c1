"""Paired statistics over events, verifier evaluation over labels, choices over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.catalog.base import big, query, r, table
from sorrel.operators import fitting, paired, verdicts

# --- paired statistics: unit = user, arm = event type, draw = day -----------------------


def runs(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("unit"), F.col("event_type").alias("arm"), F.date_trunc("day", "ts").alias("draw"), "value")


def with_stratum(spark, sf, df):
    n = runs(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"))
    return df.join(n, "unit").withColumn("stratum", F.when(F.col("n_rows") % 3 == 0, "near").when(F.col("n_rows") % 3 == 1, "mid").otherwise("far"))


_RUNS = "e AS (SELECT event_id, user_id AS unit, event_type AS arm, date_trunc('day', ts) AS draw, value FROM events)"
_STRATUM = "st AS (SELECT unit, CASE count(*) % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'mid' ELSE 'far' END AS stratum FROM e GROUP BY unit)"
_CELLS = """a AS (SELECT unit, avg(value) FILTER (arm = 'purchase') - avg(value) FILTER (arm = 'click') AS delta FROM e GROUP BY unit),
cells AS (SELECT * FROM a WHERE delta IS NOT NULL)"""
_DRAWS = """d AS (SELECT unit, draw, avg(value) FILTER (arm = 'purchase') - avg(value) FILTER (arm = 'click') AS delta FROM e GROUP BY unit, draw),
draws AS (SELECT * FROM d WHERE delta IS NOT NULL), dcells AS (SELECT unit, avg(delta) AS delta, count(*) AS n_draws FROM draws GROUP BY unit)"""


def cells(spark, sf, pair_draws=False):
    return paired.cell_deltas(runs(spark, sf), ["unit"], "draw", "arm", "value", "purchase", "click", pair_draws)


@query("arm_means", """SELECT l_returnflag AS method, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1""")
def arm_means(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").alias("n_heldout"))
    m = paired.numeric_means(li, "method")
    return m.select("method", r("l_quantity").alias("l_quantity"), r("l_extendedprice", 4).alias("l_extendedprice"), r("l_discount").alias("l_discount"), r("l_tax").alias("l_tax"))


@query("paired_units", f"""WITH {_RUNS}, u AS (SELECT unit, arg_max(value, event_id) FILTER (arm = 'purchase') AS a, arg_max(value, event_id) FILTER (arm = 'click') AS b FROM e GROUP BY unit)
SELECT unit, a, b, round(a - b, 6) AS delta FROM u WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_units(spark, sf):
    u = paired.paired_units(runs(spark, sf), ["unit"], "arm", "value", "purchase", "click", "event_id")
    return u.select("unit", "a", "b", r("delta").alias("delta"))


@query("paired_summary", f"""WITH {_RUNS}, u AS (SELECT unit, arg_max(value, event_id) FILTER (arm = 'purchase') - arg_max(value, event_id) FILTER (arm = 'click') AS delta FROM e GROUP BY unit)
SELECT count(delta)::BIGINT AS n, round(avg(delta), 6) AS mean_delta, round(avg((delta >= 0)::INT), 9) AS win_rate FROM u WHERE delta IS NOT NULL""")
def paired_summary(spark, sf):
    s = paired.paired_summary(paired.paired_units(runs(spark, sf), ["unit"], "arm", "value", "purchase", "click", "event_id"))
    return s.select(big("n").alias("n"), r("mean_delta").alias("mean_delta"), r("win_rate", 9).alias("win_rate"))


_MATRIX = """m AS (SELECT o_orderpriority AS method, CASE o_orderstatus WHEN 'O' THEN 'named' WHEN 'F' THEN 'neutral' ELSE 'other' END AS name_mode,
 CASE WHEN o_orderpriority < '4' THEN 0.4 + 0.2 * (o_orderkey % 3) END AS ip_scale, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS dino, o_custkey % 100 AS clip FROM orders)"""


def matrix_rows(spark, sf):
    o = table(spark, sf, "orders")
    mode = F.when(F.col("o_orderstatus") == "O", "named").when(F.col("o_orderstatus") == "F", "neutral").otherwise("other")
    return o.select(F.col("o_orderpriority").alias("method"), mode.alias("name_mode"), F.when(F.col("o_orderpriority") < "4", 0.4 + 0.2 * (F.col("o_orderkey") % 3)).alias("ip_scale"),
                    F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("dino"), (F.col("o_custkey") % 100).cast("double").alias("clip"))


_BEST = f"""{_MATRIX}, pi AS (SELECT ip_scale, avg(dino) FILTER (method = '1-URGENT' AND name_mode = 'neutral') AS s FROM m WHERE ip_scale IS NOT NULL GROUP BY ip_scale),
best AS (SELECT CASE WHEN count(*) FILTER (s = (SELECT max(s) FROM pi)) = 1 THEN max(ip_scale) FILTER (s = (SELECT max(s) FROM pi)) ELSE min(ip_scale) END AS ip_scale FROM pi)"""


@query("best_sweep_value", f"WITH {_BEST} SELECT round(ip_scale, 6) AS ip_scale FROM best")
def best_sweep_value(spark, sf):
    scope = (F.col("method") == "1-URGENT") & (F.col("name_mode") == "neutral")
    return paired.best_sweep_value(matrix_rows(spark, sf), "ip_scale", "dino", scope).select(r("ip_scale").alias("ip_scale"))


@query("named_minus_neutral", f"""WITH {_BEST}, f AS (SELECT m.*, coalesce(m.ip_scale = best.ip_scale, false) AS hit FROM m, best),
h AS (SELECT method, bool_or(hit) AS has FROM f GROUP BY method), s AS (SELECT f.* FROM f JOIN h USING (method) WHERE hit OR NOT has)
SELECT method, 'dino' AS metric, round(avg(dino) FILTER (name_mode = 'named') - avg(dino) FILTER (name_mode = 'neutral'), 4) AS delta FROM s GROUP BY method
UNION ALL SELECT method, 'clip', round(avg(clip) FILTER (name_mode = 'named') - avg(clip) FILTER (name_mode = 'neutral'), 4) FROM s GROUP BY method""")
def named_minus_neutral(spark, sf):
    m = matrix_rows(spark, sf)
    scope = (F.col("method") == "1-URGENT") & (F.col("name_mode") == "neutral")
    out = paired.named_minus_neutral(m, paired.best_sweep_value(m, "ip_scale", "dino", scope), "ip_scale", ["dino", "clip"])
    return out.select("method", "metric", r("delta", 4).alias("delta"))


@query("part_audit", """SELECT event_type AS part, count(*)::BIGINT AS n, round(avg((value > 20)::INT), 9) AS ref_hit_rate, round(avg((user_id % 2 = 0)::INT), 9) AS gen_hit_rate,
 round(avg(value) FILTER (value > 20 AND user_id % 2 = 0), 6) AS mean_sim, count(*) FILTER (value > 20 AND user_id % 2 = 0)::BIGINT AS n_scored FROM events GROUP BY 1""")
def part_audit(spark, sf):
    ref, gen = F.col("value") > 20, F.col("user_id") % 2 == 0
    e = table(spark, sf, "events").select(F.col("event_type").alias("part"), ref.alias("ref_box"), gen.alias("gen_box"), F.when(ref & gen, F.col("value")).alias("sim"))
    a = paired.audit_rates(e)
    return a.select("part", big("n").alias("n"), r("ref_hit_rate", 9).alias("ref_hit_rate"), r("gen_hit_rate", 9).alias("gen_hit_rate"), r("mean_sim").alias("mean_sim"), big("n_scored").alias("n_scored"))


@query("recovery_curve", """SELECT event_type AS condition, (user_id % 4)::BIGINT AS level, round(avg(CASE WHEN value > 90 THEN NULL ELSE value END), 6) AS mean_metric
FROM events WHERE value <= 90 GROUP BY 1, 2""")
def recovery_curve(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("level"),
                                          F.when(F.col("value") > 90, float("nan")).otherwise(F.col("value")).alias("dino"))
    return paired.recovery_curve(e, "dino").select("condition", big("level").alias("level"), r("mean_metric").alias("mean_metric"))


@query("two_level_contrast", f"""WITH {_RUNS}, {_CELLS}, {_DRAWS} SELECT 'arm_means' AS pairing, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean_delta, round(avg((delta > 0)::INT), 9) AS win_rate FROM cells
UNION ALL SELECT 'draw_pairs', count(*)::BIGINT, round(avg(delta), 6), round(avg((delta > 0)::INT), 9) FROM dcells""")
def two_level_contrast(spark, sf):
    """Both pairings of draws: averaged per arm first, or paired draw by draw."""
    both = cells(spark, sf).withColumn("pairing", F.lit("arm_means")).unionByName(cells(spark, sf, True).withColumn("pairing", F.lit("draw_pairs")))
    s = paired.paired_summary(both, strict=True, keys=["pairing"])
    return s.select("pairing", big("n").alias("n"), r("mean_delta").alias("mean_delta"), r("win_rate", 9).alias("win_rate"))


@query("contrast_by_stratum", f"""WITH {_RUNS}, {_STRATUM}, {_DRAWS} SELECT CASE WHEN grouping(stratum) = 1 THEN 'overall' ELSE stratum END AS stratum, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean_delta, round(avg((delta > 0)::INT), 9) AS win_rate
FROM dcells JOIN st USING (unit) GROUP BY GROUPING SETS ((), (stratum))""")
def contrast_by_stratum(spark, sf):
    c = paired.contrast_by_stratum(with_stratum(spark, sf, cells(spark, sf, True)), "stratum")
    return c.select(F.when(F.col("overall") == 1, "overall").otherwise(F.col("stratum")).alias("stratum"), big("n").alias("n"), r("mean_delta").alias("mean_delta"), r("win_rate", 9).alias("win_rate"))


@query("contrast_by_heldout", f"""WITH {_RUNS}, {_CELLS}, {_DRAWS}, h AS (SELECT cells.unit, cells.delta, coalesce(n_draws, 0) AS n FROM cells LEFT JOIN dcells USING (unit))
SELECT CASE WHEN n <= 1 THEN 'held<=1' WHEN n <= 2 THEN 'held2' WHEN n <= 4 THEN 'held3-4' ELSE 'held5+' END AS bucket, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean_delta, round(avg((delta > 0)::INT), 9) AS win_rate FROM h GROUP BY 1""")
def contrast_by_heldout(spark, sf):
    days = runs(spark, sf).where(F.col("arm").isin("purchase", "click")).groupBy("unit", "draw").agg(F.countDistinct("arm").alias("_k")).where("_k = 2")
    n = days.groupBy("unit").agg(F.count(F.lit(1)).alias("n_held"))
    c = cells(spark, sf).join(n, "unit", "left").withColumn("n_held", F.coalesce("n_held", F.lit(0))).withColumn("bucket", paired.heldout_bucket("n_held"))
    s = paired.paired_summary(c, strict=True, keys=["bucket"])
    return s.select("bucket", big("n").alias("n"), r("mean_delta").alias("mean_delta"), r("win_rate", 9).alias("win_rate"))


@query("recovery_by_stratum", f"""WITH {_RUNS}, {_STRATUM}, c AS (SELECT unit, arm, avg(value) AS m FROM e GROUP BY unit, arm)
SELECT arm, stratum, round(avg(m), 6) AS mean_metric FROM c JOIN st USING (unit) GROUP BY arm, stratum""")
def recovery_by_stratum(spark, sf):
    df = with_stratum(spark, sf, runs(spark, sf))
    return paired.recovery_by_stratum(df, ["unit"], "arm", "stratum", "value").select("arm", "stratum", r("mean_metric").alias("mean_metric"))


_W = """x AS (SELECT {k} round(delta, 9) AS delta FROM {src}), nz AS (SELECT {k} abs(delta) AS a, delta > 0 AS pos FROM x WHERE delta <> 0),
rk AS (SELECT *, rank() OVER ({p} ORDER BY a) + (count(*) OVER ({q} a) - 1) / 2.0 AS rnk FROM nz),
t AS (SELECT {k} sum(c * c * c - c) AS ties FROM (SELECT {k} a, count(*)::DOUBLE AS c FROM nz GROUP BY {k} a) {g}),
w AS (SELECT {k} count(*)::DOUBLE AS n, sum(rnk) FILTER (pos) AS wp FROM rk {g})"""


@query("wilcoxon", f"""WITH {_RUNS}, {_CELLS}, {_W.format(k='', src='cells', p='', q='PARTITION BY', g='')}
SELECT n::BIGINT AS n_nonzero, round(wp, 6) AS w_plus, round((wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w, t""")
def wilcoxon(spark, sf):
    w = paired.wilcoxon(cells(spark, sf).withColumn("delta", F.round("delta", 9)))
    return w.select(big("n_nonzero").alias("n_nonzero"), r("w_plus").alias("w_plus"), r("z").alias("z"))


@query("wilcoxon_p")
def wilcoxon_p(spark, sf):
    """Per stratum the exact or normal p; checked against exhaustive enumeration in the tests."""
    c = with_stratum(spark, sf, cells(spark, sf).withColumn("delta", F.round("delta", 9)))
    w = paired.wilcoxon(c, ["stratum"])
    return w.select("stratum", big("n_nonzero").alias("n_nonzero"), r("p_two_sided", 9).alias("p_two_sided"), r("p_greater", 9).alias("p_greater"))


@query("wilcoxon_exact_p", f"""WITH {_RUNS}, {_STRATUM}, {_CELLS}, {_W.format(k='stratum,', src='cells JOIN st USING (unit)', p='PARTITION BY stratum', q='PARTITION BY stratum,', g='GROUP BY stratum')},
d AS (SELECT stratum, list_reduce(list_prepend([1.0::DOUBLE], list([(2 * rnk)::DOUBLE] ORDER BY a)), lambda acc, g: list_transform(range(len(acc) + g[1]::BIGINT),
 lambda i: (coalesce(acc[i + 1], 0) + CASE WHEN i >= g[1] THEN coalesce(acc[(i - g[1])::BIGINT + 1], 0) ELSE 0 END) / 2)) AS chance FROM rk GROUP BY stratum)
SELECT stratum, n::BIGINT AS n_nonzero, round(least(1, 2 * list_sum(chance[(2 * greatest(coalesce(wp, 0), n * (n + 1) / 2 - coalesce(wp, 0)))::BIGINT + 1:])), 9) AS p_two_sided,
 round(list_sum(chance[(2 * coalesce(wp, 0))::BIGINT + 1:]), 9) AS p_greater FROM w JOIN d USING (stratum)""")
def wilcoxon_exact_p(spark, sf):
    """Per stratum the exact p from the distribution of rank sums, ties included."""
    c = with_stratum(spark, sf, cells(spark, sf).withColumn("delta", F.round("delta", 9)))
    w = paired.wilcoxon(c, ["stratum"], method="exact")
    return w.select("stratum", big("n_nonzero").alias("n_nonzero"), r("p_two_sided", 9).alias("p_two_sided"), r("p_greater", 9).alias("p_greater"))


@query("reliability_sweep", f"""WITH {_RUNS}, {_DRAWS}, th AS (SELECT * FROM (VALUES (1), (2), (3), (5)) v(threshold)), u AS (SELECT threshold, unit, round(delta, 9) AS delta, n_draws FROM dcells JOIN th ON n_draws >= threshold),
rk AS (SELECT threshold, delta, rank() OVER (PARTITION BY threshold ORDER BY abs(delta)) AS lo, count(*) OVER (PARTITION BY threshold, abs(delta)) AS c FROM u WHERE delta <> 0),
wx AS (SELECT threshold, count(*) AS m, coalesce(sum(lo + (c - 1) / 2) FILTER (delta > 0), 0) AS wp, sum(c * c - 1) AS ties FROM rk GROUP BY threshold),
zs AS (SELECT threshold, (wp - m * (m + 1) / 4) / nullif(sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 0) AS z FROM wx)
SELECT threshold::BIGINT AS threshold, (SELECT round(z, 6) FROM zs WHERE zs.threshold = u.threshold) AS z, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, round(stddev_pop(delta), 6) AS sd, count(*) FILTER (delta > 0)::BIGINT AS wins,
 round(avg((delta > 0)::INT), 9) AS win_rate, round(sum(n_draws * delta) / sum(n_draws), 6) AS weighted_mean FROM u GROUP BY threshold""")
def reliability_sweep(spark, sf):
    e = runs(spark, sf)
    per = paired.cell_deltas(e, ["unit", "draw"], "draw", "arm", "value", "purchase", "click", False)
    u = per.groupBy("unit").agg(F.round(F.avg("delta"), 9).alias("delta"), F.count(F.lit(1)).alias("n_draws"))
    s = paired.reliability_sweep(u, "n_draws")
    return s.select(big("threshold").alias("threshold"), big("n").alias("n"), *[r(c).alias(c) for c in ("mean", "median", "sd", "z")], big("wins").alias("wins"),
                    r("win_rate", 9).alias("win_rate"), r("weighted_mean").alias("weighted_mean"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    """Percentile interval of the mean delta per stratum, with both verdicts."""
    c = with_stratum(spark, sf, cells(spark, sf)).withColumn("delta", F.col("delta") / 100)
    ci = paired.bootstrap_ci(c, ["stratum"], "delta", ident="unit")
    return ci.select("stratum", big("n").alias("n"), r("mean").alias("mean"), r("ci_low", 4).alias("ci_low"), r("ci_high", 4).alias("ci_high"),
                     paired.harm_verdict("ci_low", "ci_high").alias("harm"), paired.gain_verdict("mean", "ci_low", "ci_high").alias("gain"))


@query("interval_verdicts", """WITH i AS (SELECT c_custkey, (c_acctbal - 6000) / 100000 AS lo, (c_acctbal - 5000) / 100000 + c_nationkey * 0.001 AS hi, c_custkey % 10 = 0 AS thin FROM customer),
m AS (SELECT *, (lo + hi) / 2 AS mean FROM i)
SELECT c_custkey, CASE WHEN thin THEN NULL WHEN lo >= -0.02 THEN 'no_harm' WHEN hi < 0 THEN 'harm' ELSE 'inconclusive' END AS harm,
 CASE WHEN thin THEN 'UNDERPOWERED' WHEN mean >= 0.02 AND lo > 0 THEN 'GAIN' WHEN mean <= -0.02 AND hi < 0 THEN 'LOSS' ELSE 'NO_LARGE_EFFECT' END AS gain FROM m""")
def interval_verdicts(spark, sf):
    bal, thin = F.col("c_acctbal"), F.col("c_custkey") % 10 == 0
    i = table(spark, sf, "customer").select("c_custkey", ((bal - 6000) / 100000).alias("lo"), ((bal - 5000) / 100000 + F.col("c_nationkey") * F.lit(0.001)).alias("hi"), thin.alias("thin"))
    i = i.withColumn("mean", (F.col("lo") + F.col("hi")) / 2)
    for c in ("lo", "hi"):
        i = i.withColumn(c, F.when(~F.col("thin"), F.col(c)))
    return i.select("c_custkey", paired.harm_verdict("lo", "hi").alias("harm"), paired.gain_verdict("mean", "lo", "hi").alias("gain"))


# --- verifier evaluation: case = labelled document ------------------------------------------

_LABELLED = """lab AS (SELECT l.doc_id AS case_id, d.lang AS cohort, l.quality = 0 AS truth_fail, l.toxic = 0 AS semantic_ok, (d.n_chars % 101) / 100.0 AS text_relevance,
 ((l.doc_id * 7919) % 100) / 100.0 AS reference_relevance FROM labels l JOIN documents d USING (doc_id))"""


def labelled(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("cohort"), (F.col("quality") == 0).alias("truth_fail"), (F.col("toxic") == 0).alias("semantic_ok"),
                    ((F.col("n_chars") % 101) / 100).alias("text_relevance"), ((F.col("doc_id") * 7919 % 100) / 100).alias("reference_relevance"))


def conf_sql(src, truth, pred, keys=""):
    """Counts and ratios as plain SQL."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
 round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 9) AS specificity, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
 round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy,
 round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc
FROM (SELECT {k}count(*) FILTER ({truth} AND {pred})::DOUBLE AS tp, count(*) FILTER (NOT {truth} AND {pred})::DOUBLE AS fp, count(*) FILTER (NOT {truth} AND NOT {pred})::DOUBLE AS tn,
 count(*) FILTER ({truth} AND NOT {pred})::DOUBLE AS fn FROM {src} {g})"""


def conf_out(df, *keys):
    return df.select(*keys, *[big(c).alias(c) for c in ("tp", "fp", "tn", "fn")], *[r(c, 9).alias(c) for c in ("recall", "specificity", "precision", "f1", "accuracy", "mcc")])


@query("confusion", f"WITH {_LABELLED} {conf_sql('lab', 'truth_fail', '(NOT semantic_ok)', 'cohort')}")
def confusion(spark, sf):
    return conf_out(verdicts.confusion(labelled(spark, sf), F.col("truth_fail"), ~F.col("semantic_ok"), ["cohort"]), "cohort")


@query("route_reference", f"WITH {_LABELLED} {conf_sql('lab', 'truth_fail', '(NOT semantic_ok OR reference_relevance < 0.3)', 'cohort')}")
def route_reference(spark, sf):
    pred = verdicts.route_reference("semantic_ok", "reference_relevance", 0.3)
    return conf_out(verdicts.confusion(labelled(spark, sf), F.col("truth_fail"), pred, ["cohort"]), "cohort")


@query("frozen_policy", f"WITH {_LABELLED} {conf_sql('lab', 'truth_fail', '(NOT semantic_ok OR (text_relevance < 0.5 AND reference_relevance < 0.4))', 'cohort')}")
def frozen_policy(spark, sf):
    _, conf = verdicts.apply_frozen(labelled(spark, sf), 0.5, 0.4)
    return conf_out(conf, "cohort")


@query("full_coverage", f"""WITH {_LABELLED} SELECT lang AS cohort, bool_and(n_chars % 500 <> 3) AS covered FROM documents GROUP BY lang""")
def full_coverage(spark, sf):
    d = table(spark, sf, "documents").withColumn("score", F.when(F.col("n_chars") % 500 == 3, float("nan")).otherwise(F.col("n_chars").cast("double")))
    langs = d.select("lang").distinct()
    from sorrel.functions.scores import finite

    per = d.groupBy("lang").agg(F.bool_and(finite("score")).alias("covered"))
    return langs.join(per, "lang").select(F.col("lang").alias("cohort"), "covered")


@query("full_coverage_overall", "SELECT bool_and(n_chars % 50000 <> 49999) AS covered FROM documents")
def full_coverage_overall(spark, sf):
    d = table(spark, sf, "documents").withColumn("score", F.when(F.col("n_chars") % 50000 == 49999, float("inf")).otherwise(F.col("n_chars").cast("double")))
    return verdicts.full_coverage(d, ["score", "n_chars"])


_VERDICT = "v AS (SELECT event_id, event_type, CASE user_id % 3 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PASS' ELSE 'ABSTAIN' END AS verdict, CASE WHEN value > 20 THEN 'fail' ELSE 'pass' END AS label, event_id % 4 <> 0 AS semantic_ok FROM events)"


def three_way(spark, sf):
    u = F.col("user_id") % 3
    return table(spark, sf, "events").select("event_type", F.when(u == 0, "FAIL").when(u == 1, "PASS").otherwise("ABSTAIN").alias("verdict"),
                                             F.when(F.col("value") > 20, "fail").otherwise("pass").alias("label"), (F.col("event_id") % 4 != 0).alias("semantic_ok"))


@query("three_way_confusion", f"""WITH {_VERDICT} SELECT event_type, count(*) FILTER (label = 'fail' AND verdict = 'FAIL')::BIGINT AS tp, count(*) FILTER (label = 'pass' AND verdict = 'FAIL')::BIGINT AS fp,
 round(count(*) FILTER (label = 'fail' AND verdict = 'FAIL') / count(*) FILTER (label = 'fail')::DOUBLE, 9) AS recall, round(count(*) FILTER (label = 'pass' AND verdict = 'FAIL') / count(*) FILTER (label = 'pass')::DOUBLE, 9) AS fp_rate,
 count(*) FILTER (verdict = 'ABSTAIN')::BIGINT AS n_abstain, count(*)::BIGINT AS n FROM v GROUP BY event_type""")
def three_way_confusion(spark, sf):
    c = verdicts.three_way_confusion(three_way(spark, sf), ["event_type"])
    return c.select("event_type", big("tp").alias("tp"), big("fp").alias("fp"), r("recall", 9).alias("recall"), r("fp_rate", 9).alias("fp_rate"), big("n_abstain").alias("n_abstain"), big("n").alias("n"))


@query("crosstab", f"""WITH {_VERDICT} SELECT count(*) FILTER (verdict = 'FAIL' AND NOT semantic_ok)::BIGINT AS both, count(*) FILTER (verdict = 'FAIL' AND semantic_ok)::BIGINT AS verifier_only,
 count(*) FILTER (verdict <> 'FAIL' AND NOT semantic_ok)::BIGINT AS semantic_only, count(*) FILTER (verdict <> 'FAIL' AND semantic_ok)::BIGINT AS neither FROM v WHERE label = 'fail'""")
def crosstab(spark, sf):
    return verdicts.crosstab(three_way(spark, sf)).select(*[big(c).alias(c) for c in ("both", "verifier_only", "semantic_only", "neither")])


@query("ground_truth", """SELECT count(*) FILTER (lang <> 'de')::BIGINT AS kept, count(*) FILTER (lang = 'de')::BIGINT AS excluded FROM documents""")
def ground_truth(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("lang") == "de", " ").when(F.col("lang") == "en", " PASS").otherwise("fail").alias("verdict"))
    _, tally = verdicts.ground_truth(d, "verdict")
    return tally.select(big("kept").alias("kept"), big("excluded").alias("excluded"))


@query("verifier_report", f"""WITH {_LABELLED}, c AS (SELECT count(*) FILTER (truth_fail AND NOT semantic_ok)::DOUBLE AS tp, count(*) FILTER (truth_fail)::DOUBLE AS nf, count(*) FILTER (NOT truth_fail AND semantic_ok)::DOUBLE AS tn, count(*) FILTER (NOT truth_fail)::DOUBLE AS np FROM lab),
w AS (SELECT *, 1.96 AS z FROM c)
SELECT round(tp / nf, 9) AS recall, round((tp / nf + z * z / (2 * nf) - z * sqrt(tp / nf * (1 - tp / nf) / nf + z * z / (4 * nf * nf))) / (1 + z * z / nf), 9) AS recall_low,
 round((tp / nf + z * z / (2 * nf) + z * sqrt(tp / nf * (1 - tp / nf) / nf + z * z / (4 * nf * nf))) / (1 + z * z / nf), 9) AS recall_high,
 round((tn / np + z * z / (2 * np) - z * sqrt(tn / np * (1 - tn / np) / np + z * z / (4 * np * np))) / (1 + z * z / np), 9) AS specificity_low,
 round((tn / np + z * z / (2 * np) + z * sqrt(tn / np * (1 - tn / np) / np + z * z / (4 * np * np))) / (1 + z * z / np), 9) AS specificity_high FROM w""")
def verifier_report(spark, sf):
    l = labelled(spark, sf)
    s, _ = verdicts.verifier_report(l.select("case_id", F.col("truth_fail").alias("is_fail")), l.select("case_id", F.col("semantic_ok").alias("ok")))
    return s.select(*[r(c, 9).alias(c) for c in ("recall", "recall_low", "recall_high", "specificity_low", "specificity_high")])


@query("verifier_case_table", f"""WITH {_LABELLED} SELECT case_id, truth_fail, NOT semantic_ok AS decision_fail, truth_fail = (NOT semantic_ok) AS correct, truth_fail AND semantic_ok AS false_negative, NOT truth_fail AND NOT semantic_ok AS false_positive FROM lab""")
def verifier_case_table(spark, sf):
    l = labelled(spark, sf)
    return verdicts.verifier_report(l.select("case_id", F.col("truth_fail").alias("is_fail")), l.select("case_id", F.col("semantic_ok").alias("ok")))[1]


@query("constant_baselines", f"WITH {_LABELLED}, b AS (SELECT truth_fail, 'always-FAIL' AS arm, true AS p FROM lab UNION ALL SELECT truth_fail, 'always-PASS', false FROM lab) {conf_sql('b', 'truth_fail', 'p', 'arm')}")
def constant_baselines(spark, sf):
    return conf_out(verdicts.constant_baselines(labelled(spark, sf), F.col("truth_fail")), "arm")


# concept scores: three phrases per labelled document, some without evidence
_CONCEPTS = f"""{_LABELLED}, sc AS (SELECT case_id, p AS phrase, CASE WHEN (case_id + p) % 7 = 0 THEN NULL ELSE 0.2 + ((case_id * 31 + p * 17) % 80) / 100.0 END AS sim,
 CASE WHEN p = 2 OR (case_id + p) % 7 = 0 THEN NULL ELSE 0.1 + ((case_id * 13 + p * 29) % 60) / 100.0 END AS sim_coarse FROM lab, (VALUES (0), (1), (2)) v(p))"""


def concept_scores(spark, sf):
    i, p = F.col("case_id"), F.col("phrase")
    s = labelled(spark, sf).select("case_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("phrase"))
    blind = (i + p) % 7 == 0
    return s.select("case_id", "phrase", F.when(~blind, F.lit(0.2) + (i * 31 + p * 17) % 80 / 100).alias("sim"),
                    F.when(~blind & (p != 2), F.lit(0.1) + (i * 13 + p * 29) % 60 / 100).alias("sim_coarse"))


def judged_cases(spark, sf):
    return labelled(spark, sf).select("case_id", F.col("truth_fail").alias("is_fail"), F.col("semantic_ok").alias("ok"))


_ARMS = """arms AS (SELECT {g}, truth_fail, 'grounded' AS arm, gf AS p FROM cf UNION ALL SELECT {g}, truth_fail, 'semantic', NOT semantic_ok FROM cf UNION ALL SELECT {g}, truth_fail, 'fused', gf OR NOT semantic_ok FROM cf)"""


@query("concept_states", f"""WITH {_CONCEPTS} SELECT case_id, phrase::BIGINT AS phrase, CASE WHEN sim IS NULL THEN 'ABSTAIN' WHEN sim < 0.35 THEN 'MISSING' WHEN round_even(sim - sim_coarse, 9) < 0.05 THEN 'FINE_MISMATCH' ELSE 'PRESENT' END AS state FROM sc""")
def concept_states(spark, sf):
    s = concept_scores(spark, sf)
    return s.select("case_id", big("phrase").alias("phrase"), verdicts.state_at(F.col("sim"), F.col("sim") - F.col("sim_coarse"), 0.35, 0.05).alias("state"))


@query("fused_verdicts", f"""WITH {_CONCEPTS}, s AS (SELECT *, CASE WHEN sim IS NULL THEN 'ABSTAIN' WHEN sim < 0.35 THEN 'MISSING' WHEN round_even(sim - sim_coarse, 9) < 0.05 THEN 'FINE_MISMATCH' ELSE 'PRESENT' END AS state FROM sc),
a AS (SELECT case_id, bool_or(state IN ('MISSING', 'FINE_MISMATCH')) AS g, arg_min(phrase, (coalesce(sim, 0), phrase)) FILTER (state IN ('MISSING', 'FINE_MISMATCH')) AS low, min(sim) FILTER (state <> 'ABSTAIN') AS score FROM s GROUP BY case_id)
SELECT a.case_id, NOT g AND semantic_ok AS ok, CASE WHEN g AND NOT semantic_ok THEN 'BOTH_FAIL' WHEN g THEN 'GROUNDED_ONLY' WHEN NOT semantic_ok THEN 'SEMANTIC_ONLY' ELSE 'BOTH_PASS' END AS agreement,
 CASE WHEN g THEN 'p' || low WHEN NOT semantic_ok THEN cohort END AS target, round(score, 9) AS score FROM a JOIN lab USING (case_id)""")
def fused_verdicts(spark, sf):
    s = concept_scores(spark, sf)
    s = s.select("case_id", F.concat(F.lit("p"), F.col("phrase").cast("string")).alias("phrase"), "sim",
                 verdicts.state_at(F.col("sim"), F.col("sim") - F.col("sim_coarse"), 0.35, 0.05).alias("state"))
    sem = labelled(spark, sf).select("case_id", F.col("semantic_ok").alias("ok"), F.col("cohort").alias("first_issue"))
    f = verdicts.fuse(s, sem)
    return f.select("case_id", "ok", "agreement", "target", r("score", 9).alias("score"))


@query("sweep_tau", f"""WITH {_CONCEPTS}, g AS (SELECT round(i * 0.01, 2)::DOUBLE AS tau FROM range(1, 100) t(i)),
cf AS (SELECT tau, case_id, any_value(truth_fail) AS truth_fail, any_value(semantic_ok) AS semantic_ok, bool_or(coalesce(sim < tau, false)) AS gf FROM sc JOIN lab USING (case_id), g GROUP BY tau, case_id),
{_ARMS.format(g='tau')}, c AS ({conf_sql('arms', 'truth_fail', 'p', 'tau, arm')})
SELECT tau, arm, tp, fp, recall, specificity, mcc, round((SELECT avg((sim IS NULL)::INT) FROM sc), 9) AS abstain_rate FROM c""")
def sweep_tau(spark, sf):
    s = verdicts.sweep_tau(concept_scores(spark, sf), judged_cases(spark, sf))
    return s.select("tau", "arm", big("tp").alias("tp"), big("fp").alias("fp"), *[r(c, 9).alias(c) for c in ("recall", "specificity", "mcc", "abstain_rate")])


_DELTA_CF = """g AS (SELECT round(i * 0.005, 3)::DOUBLE AS delta FROM range(-40, 41) t(i)),
cf AS (SELECT delta, case_id, any_value(truth_fail) AS truth_fail, any_value(semantic_ok) AS semantic_ok,
 bool_or(coalesce(sim < 0.25, false) OR coalesce(round_even(sim - sim_coarse, 9) < delta, false)) AS gf, bool_or(coalesce(sim < 0.25, false)) AS base FROM sc JOIN lab USING (case_id), g GROUP BY delta, case_id)"""


@query("sweep_delta", f"""WITH {_CONCEPTS}, {_DELTA_CF}, {_ARMS.format(g='delta')}, c AS ({conf_sql('arms', 'truth_fail', 'p', 'delta, arm')})
SELECT delta, arm, tp, fp, recall, specificity, mcc FROM c""")
def sweep_delta(spark, sf):
    s = verdicts.sweep_delta(concept_scores(spark, sf), judged_cases(spark, sf), F.col("sim") - F.col("sim_coarse"))
    return s.select("delta", "arm", big("tp").alias("tp"), big("fp").alias("fp"), *[r(c, 9).alias(c) for c in ("recall", "specificity", "mcc")])


@query("best_tau", f"""WITH {_CONCEPTS}, g AS (SELECT round(i * 0.01, 2)::DOUBLE AS tau FROM range(1, 100) t(i)),
cf AS (SELECT tau, case_id, any_value(truth_fail) AS truth_fail, any_value(semantic_ok) AS semantic_ok, bool_or(coalesce(sim < tau, false)) AS gf FROM sc JOIN lab USING (case_id), g GROUP BY tau, case_id),
{_ARMS.format(g='tau')}, c AS (SELECT tau, arm, (avg(p::INT) FILTER (truth_fail) + avg((NOT p)::INT) FILTER (NOT truth_fail)) / 2 AS b FROM arms GROUP BY tau, arm),
k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY b DESC, tau) AS rn FROM c) SELECT arm, tau AS best_tau FROM k WHERE rn = 1""")
def best_tau(spark, sf):
    return verdicts.best_grid_point(verdicts.sweep_tau(concept_scores(spark, sf), judged_cases(spark, sf)), "tau")


_RULE = f"""{_CONCEPTS}, {_DELTA_CF}, ev AS (SELECT delta, count(*) FILTER (truth_fail AND NOT (base OR NOT semantic_ok) AND gf)::BIGINT AS caught,
 count(*) FILTER (NOT truth_fail AND NOT (base OR NOT semantic_ok) AND gf)::BIGINT AS new_false_positives, bool_and(NOT (truth_fail AND (base OR NOT semantic_ok)) OR gf OR NOT semantic_ok) AS retained FROM cf GROUP BY delta)"""


def rule(spark, sf):
    split = verdicts.baseline_split(concept_scores(spark, sf), judged_cases(spark, sf), F.col("sim") - F.col("sim_coarse"))
    return verdicts.evaluate_rule(split)


@query("evaluate_rule", f"WITH {_RULE} SELECT delta, caught, new_false_positives, retained, caught >= 4 AND new_false_positives = 0 AND retained AS passes FROM ev")
def evaluate_rule(spark, sf):
    return rule(spark, sf).select("delta", big("caught").alias("caught"), big("new_false_positives").alias("new_false_positives"), "retained", "passes")


@query("baseline_split", f"""WITH {_CONCEPTS}, b AS (SELECT case_id, bool_or(coalesce(sim < 0.25, false)) AS base FROM sc GROUP BY case_id)
SELECT CASE WHEN truth_fail AND (base OR NOT semantic_ok) THEN 'caught' WHEN truth_fail THEN 'missed' WHEN base OR NOT semantic_ok THEN 'inherited_fp' ELSE 'clean' END AS part, count(*)::BIGINT AS n FROM b JOIN lab USING (case_id) GROUP BY 1""")
def baseline_split(spark, sf):
    s = verdicts.baseline_split(concept_scores(spark, sf), judged_cases(spark, sf), F.col("sim") - F.col("sim_coarse"))
    return s.groupBy("part").agg(big(F.count(F.lit(1))).alias("n"))


@query("robust_band", f"""WITH {_RULE}, p AS (SELECT delta, caught, caught BETWEEN 1 AND 30 AS passes FROM ev),
i AS (SELECT *, row_number() OVER (ORDER BY delta) - row_number() OVER (PARTITION BY passes ORDER BY delta) AS isl FROM p),
b AS (SELECT isl FROM i WHERE passes GROUP BY isl HAVING count(*) >= 3 ORDER BY count(*) DESC, min(delta) LIMIT 1) SELECT delta, caught FROM i WHERE passes AND isl IN (SELECT isl FROM b)""")
def robust_band(spark, sf):
    p = rule(spark, sf).withColumn("passes", F.col("caught").between(1, 30))
    return verdicts.robust_band(p, "delta").select("delta", big("caught").alias("caught"))


# --- fits ---------------------------------------------------------------------------------

@query("candidate_thresholds", f"""WITH {_LABELLED}, v AS (SELECT DISTINCT text_relevance AS x FROM lab), m AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS t FROM v)
SELECT round(t, 9) AS threshold FROM m WHERE t IS NOT NULL UNION ALL SELECT round(min(x) - 1, 9) FROM v UNION ALL SELECT round(max(x) + 1, 9) FROM v""")
def candidate_thresholds(spark, sf):
    return fitting.candidate_thresholds(labelled(spark, sf), "text_relevance").select(r("threshold", 9).alias("threshold"))


_GRID = """v AS (SELECT DISTINCT cohort, text_relevance AS x FROM lab), e AS (SELECT cohort, min(x) AS lo, max(x) AS hi, greatest(1e-9, (max(x) - min(x)) * 1e-6) AS eps FROM v GROUP BY cohort),
c AS (SELECT cohort, (x + lead(x) OVER (PARTITION BY cohort ORDER BY x)) / 2 AS t FROM v UNION ALL SELECT cohort, lo - eps FROM e UNION ALL SELECT cohort, hi + eps FROM e)"""


@query("fit_threshold", f"""WITH {_LABELLED}, {_GRID}, s AS (SELECT cohort, t, coalesce(avg((text_relevance < t)::INT) FILTER (truth_fail), 0) AS rec, coalesce(avg((text_relevance >= t)::INT) FILTER (NOT truth_fail), 0) AS spec FROM lab JOIN c USING (cohort) WHERE t IS NOT NULL GROUP BY cohort, t),
k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY round((rec + spec) / 2, 12) DESC, spec DESC, t) AS rn FROM s)
SELECT cohort, round(t, 9) AS threshold, round((rec + spec) / 2, 9) AS balanced_accuracy, round(spec, 9) AS specificity FROM k WHERE rn = 1""")
def fit_threshold(spark, sf):
    f = fitting.fit_threshold(labelled(spark, sf), "text_relevance", F.col("truth_fail"), ["cohort"])
    return f.select("cohort", r("threshold", 9).alias("threshold"), r("balanced_accuracy", 9).alias("balanced_accuracy"), r("specificity", 9).alias("specificity"))


@query("leave_one_out_fit", f"""WITH {_LABELLED}, f AS (SELECT case_id AS fold, cohort, text_relevance AS own, truth_fail AS own_truth FROM lab),
tr AS (SELECT f.fold, lab.text_relevance AS x, lab.truth_fail FROM f JOIN lab ON lab.cohort = f.cohort AND lab.case_id <> f.fold),
v AS (SELECT DISTINCT fold, x FROM tr), e AS (SELECT fold, min(x) AS lo, max(x) AS hi, greatest(1e-9, (max(x) - min(x)) * 1e-6) AS eps FROM v GROUP BY fold),
c AS (SELECT fold, (x + lead(x) OVER (PARTITION BY fold ORDER BY x)) / 2 AS t FROM v UNION ALL SELECT fold, lo - eps FROM e UNION ALL SELECT fold, hi + eps FROM e),
g AS (SELECT fold, x, count(*) FILTER (truth_fail) AS nf, count(*) FILTER (NOT truth_fail) AS np FROM tr GROUP BY fold, x),
s AS (SELECT c.fold, c.t, coalesce(sum(nf) FILTER (x < t), 0) / nullif(sum(nf), 0)::DOUBLE AS rec, coalesce(sum(np) FILTER (x >= t), 0) / nullif(sum(np), 0)::DOUBLE AS spec FROM c JOIN g USING (fold) WHERE t IS NOT NULL GROUP BY c.fold, c.t),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round((coalesce(rec, 0) + coalesce(spec, 0)) / 2, 12) DESC, coalesce(spec, 0) DESC, t) AS rn FROM s)
SELECT f.cohort, f.own AS text_relevance, f.own_truth AS truth_fail, count(*)::BIGINT AS n, round(max(k.t), 9) AS threshold, bool_or(f.own < k.t) AS predicted_fail
FROM f JOIN k ON k.fold = f.fold AND k.rn = 1 GROUP BY f.cohort, f.own, f.own_truth""")
def leave_one_out_fit(spark, sf):
    f = fitting.loo_thresholds(labelled(spark, sf), "text_relevance", F.col("truth_fail"), ["cohort"])
    return f.select("cohort", "text_relevance", "truth_fail", big("n").alias("n"), r("threshold", 9).alias("threshold"), "predicted_fail")


_WILSON = """round(greatest(0, (({a} / {n}::DOUBLE + 1.96 * 1.96 / (2 * {n})) - 1.96 * sqrt({a} / {n}::DOUBLE * (1 - {a} / {n}::DOUBLE) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})), 6)"""


@query("signal_report", f"""WITH {_LABELLED}, lg AS (SELECT 'text_relevance' AS signal, case_id, text_relevance AS x, truth_fail FROM lab UNION ALL SELECT 'reference_relevance', case_id, reference_relevance, truth_fail FROM lab),
f AS (SELECT signal, case_id AS fold, x AS own, truth_fail AS own_truth FROM lg UNION ALL SELECT DISTINCT signal, -1, NULL::DOUBLE, NULL::BOOLEAN FROM lg),
g AS (SELECT f.signal, f.fold, lg.x, count(*) FILTER (truth_fail) AS nf, count(*) FILTER (NOT truth_fail) AS np FROM f JOIN lg ON lg.signal = f.signal AND lg.case_id <> f.fold GROUP BY ALL),
e AS (SELECT signal, fold, min(x) AS lo, max(x) AS hi, greatest(1e-9, (max(x) - min(x)) * 1e-6) AS eps FROM g GROUP BY signal, fold),
c AS (SELECT signal, fold, (x + lead(x) OVER (PARTITION BY signal, fold ORDER BY x)) / 2 AS t FROM g UNION ALL SELECT signal, fold, lo - eps FROM e UNION ALL SELECT signal, fold, hi + eps FROM e),
s AS (SELECT c.signal, c.fold, c.t, coalesce(sum(nf) FILTER (x < t), 0) / nullif(sum(nf), 0)::DOUBLE AS rec, coalesce(sum(np) FILTER (x >= t), 0) / nullif(sum(np), 0)::DOUBLE AS spec FROM c JOIN g USING (signal, fold) WHERE t IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY signal, fold ORDER BY round((coalesce(rec, 0) + coalesce(spec, 0)) / 2, 12) DESC, coalesce(spec, 0) DESC, t) AS rn FROM s),
w AS (SELECT * FROM k WHERE rn = 1), whole AS (SELECT signal, t FROM w WHERE fold = -1),
p AS (SELECT f.signal, 'leave_one_out' AS sample, own_truth AS t, own < w.t AS p FROM f JOIN w USING (signal, fold) WHERE fold <> -1 UNION ALL SELECT lg.signal, 'in_sample', truth_fail, x < whole.t FROM lg JOIN whole USING (signal)),
q AS (SELECT signal, sample, count(*) FILTER (t AND p)::BIGINT AS tp, count(*) FILTER (NOT t AND p)::BIGINT AS fp, count(*) FILTER (NOT t AND NOT p)::BIGINT AS tn, count(*) FILTER (t AND NOT p)::BIGINT AS fn FROM p GROUP BY ALL)
SELECT signal, sample, round(whole.t, 9) AS threshold, tp, fp, tn, fn, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(tn / (tn + fp)::DOUBLE, 9) AS specificity,
 {_WILSON.format(a='tp', n='(tp + fn)')} AS recall_low, {_WILSON.format(a='tn', n='(tn + fp)')} AS specificity_low FROM q JOIN whole USING (signal)""")
def signal_report(spark, sf):
    """Each signal alone as a detector, on its own rows and left one out."""
    s = fitting.signal_report(labelled(spark, sf), ["text_relevance", "reference_relevance"], F.col("truth_fail"))
    return s.select("signal", "sample", r("threshold", 9).alias("threshold"), *[big(c).alias(c) for c in ("tp", "fp", "tn", "fn")], r("recall", 9).alias("recall"), r("specificity", 9).alias("specificity"),
                    r("recall_low").alias("recall_low"), r("specificity_low").alias("specificity_low"))


@query("fit_two_thresholds", f"""WITH {_LABELLED}, tv AS (SELECT DISTINCT text_relevance AS x FROM lab), rv AS (SELECT DISTINCT reference_relevance AS x FROM lab),
tt AS (SELECT t FROM (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS t FROM tv) WHERE t IS NOT NULL UNION ALL SELECT min(x) - 1 FROM tv UNION ALL SELECT max(x) + 1 FROM tv),
rt AS (SELECT t FROM (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS t FROM rv) WHERE t IS NOT NULL UNION ALL SELECT min(x) - 1 FROM rv UNION ALL SELECT max(x) + 1 FROM rv),
n AS (SELECT count(*) FILTER (truth_fail)::DOUBLE AS nf, count(*) FILTER (NOT truth_fail)::DOUBLE AS np FROM lab),
g AS (SELECT tt.t AS tt, rt.t AS rt, count(*) FILTER (truth_fail AND (NOT semantic_ok OR (text_relevance < tt.t AND reference_relevance < rt.t)))::DOUBLE AS tp,
 count(*) FILTER (NOT truth_fail AND (NOT semantic_ok OR (text_relevance < tt.t AND reference_relevance < rt.t)))::DOUBLE AS fp FROM tt, rt, lab GROUP BY tt.t, rt.t),
m AS (SELECT *, nf - tp AS fn, np - fp AS tn FROM g, n),
o AS (SELECT *, tp / nf >= 0.733 AND fp / np <= 0.0834 AS feasible, CASE WHEN (tp + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM m),
k AS (SELECT *, row_number() OVER (ORDER BY feasible DESC, round(mcc, 12) DESC, fp, tp DESC, tp + fp, tt, rt) AS rn FROM o)
SELECT round(tt, 9) AS text_threshold, round(rt, 9) AS reference_threshold, feasible, round(tp / nf, 9) AS recall, fp::BIGINT AS false_positives, round(mcc, 9) AS mcc, (tp + fp)::BIGINT AS routed FROM k WHERE rn = 1""")
def fit_two_thresholds(spark, sf):
    f = fitting.fit_detector(labelled(spark, sf))
    return f.select(r("text_threshold", 9).alias("text_threshold"), r("reference_threshold", 9).alias("reference_threshold"), "feasible", r("recall", 9).alias("recall"),
                    big("false_positives").alias("false_positives"), r("mcc", 9).alias("mcc"), big("routed").alias("routed"))


@query("leave_one_out_detector")
def leave_one_out_detector(spark, sf):
    """All detector folds at once; equal to plain refits on small tables in the tests."""
    f = fitting.loo_detector(labelled(spark, sf))
    return f.select("semantic_ok", "truth_fail", "text_relevance", "reference_relevance", big("n").alias("n"), "feasible", r("text_threshold", 9).alias("text_threshold"),
                    r("reference_threshold", 9).alias("reference_threshold"), "predicted_fail")


# --- candidates: case = conversation, attempt = turn ----------------------------------------

_CAND = """cand AS (SELECT conv_id AS case_id, turn AS attempt, role = 'assistant' AND length(text) % 3 = 0 AS ok, CASE WHEN role = 'system' THEN NULL ELSE length(text) / 1000.0 END AS score,
 (length(text) % 25) / 25.0 AS text_relevance, (length(text) * 7 % 20) / 20.0 AS reference_relevance, length(text) % 4 <> 0 AS semantic_ok, (length(text) * 11 % 40) / 40.0 AS dino FROM conversations)"""


def candidates(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("attempt"), ((F.col("role") == "assistant") & (n % 3 == 0)).alias("ok"),
        F.when(F.col("role") != "system", n / 1000).alias("score"), (n % 25 / 25).alias("text_relevance"), (n * 7 % 20 / 20).alias("reference_relevance"),
        (n % 4 != 0).alias("semantic_ok"), (n * 11 % 40 / 40).alias("dino"))


_WINNER = """w AS (SELECT case_id, CASE WHEN bool_or(attempt = 0 AND ok) THEN 0 WHEN count(*) FILTER (attempt > 0 AND ok) > 0 THEN min(attempt) FILTER (attempt > 0 AND ok)
 ELSE coalesce(arg_min(attempt, (-score, attempt)) FILTER (score IS NOT NULL), 0) END::BIGINT AS winner, bool_or(attempt = 0 AND ok) AS draft_ok FROM cand GROUP BY case_id)"""


@query("winner", f"WITH {_CAND}, {_WINNER} SELECT case_id, winner FROM w")
def winner(spark, sf):
    return verdicts.select_winner(candidates(spark, sf))


@query("outcome_buckets", f"WITH {_CAND}, {_WINNER} SELECT CASE WHEN draft_ok THEN 'healthy' WHEN winner <> 0 THEN 'repaired' ELSE 'unrepairable' END AS bucket, count(*)::BIGINT AS n FROM w GROUP BY 1")
def outcome_buckets(spark, sf):
    c = candidates(spark, sf)
    w = verdicts.select_winner(c).join(c.groupBy("case_id").agg(F.bool_or((F.col("attempt") == 0) & F.col("ok")).alias("draft_ok")), "case_id")
    return w.groupBy(verdicts.outcome("draft_ok", "winner").alias("bucket")).agg(big(F.count(F.lit(1))).alias("n"))


_REPAIR = """d AS (SELECT case_id, text_relevance AS dt, reference_relevance AS dr, dino AS dd FROM cand WHERE attempt = 0),
el AS (SELECT c.*, dt, dr, dd, c.text_relevance - dt + 1e-12 >= {tm} AND {second} AS eligible FROM cand c JOIN d USING (case_id) WHERE attempt > 0),
b AS (SELECT case_id, attempt, row_number() OVER (PARTITION BY case_id ORDER BY text_relevance DESC, {third} attempt) AS rn FROM el WHERE eligible)"""


@query("repair_select", f"""WITH {_CAND}, {_REPAIR.format(tm='0.08', second='c.reference_relevance - dr + 1e-12 >= 0.1', third='reference_relevance DESC,')}
SELECT d.case_id, coalesce(b.attempt, 0)::BIGINT AS selected FROM d LEFT JOIN b ON d.case_id = b.case_id AND rn = 1""")
def repair_select(spark, sf):
    return verdicts.select_repair(candidates(spark, sf), 0.08, 0.1)


@query("repair_select_judged", f"""WITH {_CAND}, {_REPAIR.format(tm='0.0', second='c.semantic_ok', third='')}
SELECT d.case_id, coalesce(b.attempt, 0)::BIGINT AS selected FROM d LEFT JOIN b ON d.case_id = b.case_id AND rn = 1""")
def repair_select_judged(spark, sf):
    return verdicts.select_repair(candidates(spark, sf), 0.0, judged=True)


@query("pick_best", f"""WITH {_CAND} SELECT case_id, attempt AS best FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ok DESC, score DESC NULLS LAST, attempt) AS rn FROM cand) WHERE rn = 1""")
def pick_best(spark, sf):
    return verdicts.pick_best(candidates(spark, sf), ["case_id"], "attempt").withColumnRenamed("attempt", "best")


@query("select_box", f"""WITH {_CAND}, x AS (SELECT case_id, attempt, text_relevance AS conf, CASE WHEN semantic_ok THEN NULL ELSE reference_relevance END AS proto FROM cand),
a AS (SELECT case_id, count(proto) AS np, arg_min(attempt, (-conf, attempt)) AS bc, arg_min(attempt, (-proto, attempt)) FILTER (proto IS NOT NULL) AS bp FROM x GROUP BY case_id)
SELECT case_id, CASE WHEN np >= 2 THEN bp ELSE bc END AS box, CASE WHEN np >= 2 THEN 'prototype' ELSE 'confidence' END AS rule FROM a""")
def select_box(spark, sf):
    c = candidates(spark, sf).select("case_id", "attempt", F.col("text_relevance").alias("dino_conf"), F.when(~F.col("semantic_ok"), F.col("reference_relevance")).alias("sim_proto"))
    return verdicts.select_box(c, ["case_id"], "attempt").select("case_id", F.col("attempt").alias("box"), "rule")


@query("proto_margin_at_confidence", f"""WITH {_CAND}, x AS (SELECT case_id, attempt, text_relevance AS conf, reference_relevance - dino AS margin FROM cand WHERE semantic_ok)
SELECT case_id, round(arg_min(margin, (-conf, attempt)), 9) AS margin FROM x GROUP BY case_id""")
def proto_margin_at_confidence(spark, sf):
    """Margin at the most confident candidate with both prototype scores."""
    c = candidates(spark, sf).select("case_id", "attempt", F.struct(
        "attempt", F.col("text_relevance").alias("dino_conf"), F.when(F.col("semantic_ok"), F.col("reference_relevance")).alias("sim_proto"),
        F.col("dino").alias("sim_proto_coarse")).alias("c"))
    # candidates of one case: bounded by its attempts
    per = c.groupBy("case_id").agg(F.sort_array(F.collect_list("c")).alias("candidates"))
    out = per.select("case_id", r(verdicts.prototype_margin("candidates"), 9).alias("margin"))
    return out.where(F.col("margin").isNotNull())


@query("gain_margins", f"""WITH {_CAND}, d AS (SELECT case_id, text_relevance AS dt FROM cand WHERE attempt = 0)
SELECT DISTINCT round(text_relevance - dt, 9) + 0.0 AS margin FROM cand JOIN d USING (case_id) WHERE attempt > 0 AND round(text_relevance - dt, 12) >= 0 UNION SELECT 0.0""")
def gain_margins(spark, sf):
    return fitting.gain_margins(candidates(spark, sf), "text_relevance").select(r("margin", 9).alias("margin")).distinct()


_FIT = """d AS (SELECT case_id, text_relevance AS dt, reference_relevance AS dr, dino AS dd FROM cand WHERE attempt = 0),
att AS (SELECT c.case_id, attempt, c.text_relevance AS tx, c.reference_relevance AS rx, round(c.text_relevance - dt, 12) AS g, {h} AS h, dino > dd AS better, dino - dd AS delta FROM cand c JOIN d USING (case_id) WHERE attempt > 0),
orc AS (SELECT case_id, arg_min(attempt, (-dino, attempt)) AS oracle FROM cand GROUP BY case_id),
tm AS (SELECT DISTINCT g AS tm FROM att WHERE g >= 0 UNION SELECT 0.0), rm AS ({rm}),
p AS (SELECT tm, rm, att.*, g >= tm AND h >= rm AS el FROM tm, rm, att),
s AS (SELECT tm, rm, case_id, min((-tx, {tie} attempt, delta)) FILTER (el) AS pick, count(*) AS n, count(*) FILTER (el = better) AS rt FROM p GROUP BY tm, rm, case_id),
q AS (SELECT tm, rm, orc.case_id, oracle, coalesce({att}, 0) AS sel, coalesce({dl}, 0) AS delta, coalesce(n, 0) AS n, coalesce(rt, 0) AS rt FROM s JOIN orc USING (case_id)
 UNION ALL SELECT tm, rm, case_id, 0, 0, 0, 0, 0 FROM tm, rm, orc WHERE case_id NOT IN (SELECT case_id FROM att)),
m AS (SELECT tm, rm, sum(rt) / sum(n)::DOUBLE AS sign, count(*) FILTER (delta < -0.02) AS harm, round(avg(delta), 12) AS mean, avg((sel = oracle)::INT) AS exact FROM q GROUP BY tm, rm),
k AS (SELECT *, sign >= 0.75 AND harm <= 1 AND mean > 0 AS feasible FROM m), z AS (SELECT *, row_number() OVER (ORDER BY feasible DESC, mean DESC, exact DESC, tm DESC, rm DESC) AS rn FROM k)
SELECT round(tm, 9) AS text_margin, round(rm, 9) AS reference_margin, feasible, round(sign, 9) AS sign_accuracy, harm::BIGINT AS harmful, round(mean, 9) AS mean_delta, round(exact, 9) AS exact_best_rate FROM z WHERE rn = 1"""


def _margins(df):
    return df.select(r("text_margin", 9).alias("text_margin"), r("reference_margin", 9).alias("reference_margin"), "feasible", r("sign_accuracy", 9).alias("sign_accuracy"),
                     big("harmful").alias("harmful"), r("mean_delta", 9).alias("mean_delta"), r("exact_best_rate", 9).alias("exact_best_rate"))


@query("fit_selector", "WITH " + _CAND + ", " + _FIT.format(h="round(c.reference_relevance - dr, 12)", rm="SELECT DISTINCT h AS rm FROM att WHERE h >= 0 UNION SELECT 0.0", tie="-rx,", att="pick[3]", dl="pick[4]"))
def fit_selector(spark, sf):
    return _margins(fitting.fit_selector(candidates(spark, sf)))


@query("fit_selector_judged", "WITH " + _CAND + ", " + _FIT.format(h="CASE WHEN semantic_ok THEN 0.0 ELSE -1.0 END", rm="SELECT 0.0 AS rm", tie="", att="pick[2]", dl="pick[3]"))
def fit_selector_judged(spark, sf):
    return _margins(fitting.fit_selector(candidates(spark, sf), judged=True))


@query("leave_one_out_selector")
def leave_one_out_selector(spark, sf):
    """Margins per held-out case and the selection they give; equal to plain refits in the tests."""
    c = candidates(spark, sf)
    m = fitting.loo_selector(c, judged=True)
    a = fitting.apply_margins(c, m, judged=True)
    return m.join(a, "case_id").select("case_id", r("text_margin", 9).alias("text_margin"), "feasible", "selected", r("dino_delta", 9).alias("dino_delta"), "exact", big("n_pairs").alias("n_pairs"), big("right_pairs").alias("right_pairs"))


@query("leave_one_out_selector_margins")
def leave_one_out_selector_margins(spark, sf):
    """Text and reference margins per held-out case and the selection they give; equal to plain refits in the tests."""
    c = candidates(spark, sf)
    m = fitting.loo_selector(c)
    a = fitting.apply_margins(c, m)
    return m.join(a, "case_id").select("case_id", *[r(x, 9).alias(x) for x in ("text_margin", "reference_margin")], "feasible", "selected", r("dino_delta", 9).alias("dino_delta"),
                                       "exact", big("n_pairs").alias("n_pairs"), big("right_pairs").alias("right_pairs"))


@query("pairwise_selector", f"""WITH {_CAND}, d AS (SELECT case_id, text_relevance AS df, dino AS da FROM cand WHERE attempt = 0), j AS (SELECT c.*, df, da FROM cand c JOIN d USING (case_id)),
p AS (SELECT case_id, count(*) FILTER (attempt > 0) AS n, count(*) FILTER (attempt > 0 AND (text_relevance > df) = (dino > da)) AS rt, arg_min(attempt, (-text_relevance, attempt)) AS sel,
 arg_min(dino, (-text_relevance, attempt)) - any_value(da) AS delta, arg_min(attempt, (-dino, attempt)) AS orc FROM j GROUP BY case_id)
SELECT sum(n)::BIGINT AS comparisons, round(sum(rt) / sum(n)::DOUBLE, 9) AS sign_accuracy, count(*)::BIGINT AS cases, round(avg((sel = orc)::INT), 9) AS exact_oracle, round(avg(delta), 9) AS mean_delta, count(*) FILTER (delta < -0.02)::BIGINT AS harmful FROM p WHERE n > 0""")
def pairwise_selector(spark, sf):
    q = verdicts.pairwise_quality(candidates(spark, sf), "text_relevance", "dino")
    return q.select(big("comparisons").alias("comparisons"), r("sign_accuracy", 9).alias("sign_accuracy"), big("cases").alias("cases"), r("exact_oracle", 9).alias("exact_oracle"),
                    r("mean_delta", 9).alias("mean_delta"), big("harmful").alias("harmful"))


@query("eligibility_reasons", """SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'mask_not_grounded' WHEN n_chars % 5 = 1 THEN 'corrupt_artifact' WHEN n_chars % 5 = 2 THEN 'no_prepared_reference' ELSE 'eligible' END AS reason, least(3, n_chars % 5)::BIGINT AS rounds FROM documents""")
def eligibility_reasons(spark, sf):
    m = F.col("n_chars") % 5
    d = table(spark, sf, "documents").select("doc_id", (m == 0).alias("failed"), F.when(m != 1, True).alias("mask"), F.when(m > 2, m).alias("attempts"), m.alias("n"))
    return d.select("doc_id", verdicts.eligibility("failed", "mask", "attempts").alias("reason"), big(verdicts.rounds_for(3, "n")).alias("rounds"))


# --- reports ------------------------------------------------------------------------------

_STUDY = f"""{_LABELLED}, ar AS (SELECT case_id, cohort, arm, CASE WHEN arm = 'arm1' THEN 0.0 ELSE round(text_relevance - reference_relevance, 9) END AS delta, text_relevance AS whole_clip, reference_relevance AS whole_siglip,
 CASE WHEN arm = 'arm1' THEN NULL ELSE 1 - reference_relevance / 10 END AS preservation, arm = 'arm2' AND truth_fail AS generation_failed FROM lab, (VALUES ('arm1'), ('arm2'), ('arm3')) v(arm))"""


def study_rows(spark, sf):
    l = labelled(spark, sf).withColumn("arm", F.explode(F.array(F.lit("arm1"), F.lit("arm2"), F.lit("arm3"))))
    first = F.col("arm") == "arm1"
    return l.select("case_id", "cohort", "arm", F.when(first, 0.0).otherwise(F.round(F.col("text_relevance") - F.col("reference_relevance"), 9)).alias("delta"),
                    F.col("text_relevance").alias("whole_clip"), F.col("reference_relevance").alias("whole_siglip"), F.when(~first, 1 - F.col("reference_relevance") / 10).alias("preservation"),
                    ((F.col("arm") == "arm2") & F.col("truth_fail")).alias("generation_failed"))


@query("arm_report", f"""WITH {_STUDY} SELECT cohort, arm, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean_delta, round(avg(whole_clip), 6) AS whole_clip, round(avg(whole_siglip), 6) AS whole_siglip, round(min(preservation), 6) AS preservation_min,
 count(*) FILTER (delta > 0)::BIGINT AS improved, count(*) FILTER (delta = 0)::BIGINT AS unchanged, count(*) FILTER (delta < 0)::BIGINT AS worsened, count(*) FILTER (generation_failed)::BIGINT AS generation_failed,
 CASE WHEN count(delta) >= 5 THEN true END AS interval_holds_mean, CASE WHEN count(delta) >= 5 THEN min(delta) = max(delta) END AS interval_is_point FROM ar GROUP BY cohort, arm""")
def arm_report(spark, sf):
    a = verdicts.arm_report(study_rows(spark, sf))
    return a.select("cohort", "arm", big("n").alias("n"), *[r(c).alias(c) for c in ("mean_delta", "whole_clip", "whole_siglip", "preservation_min")],
                    *[big(c).alias(c) for c in ("improved", "unchanged", "worsened", "generation_failed")],
                    F.col("mean_delta").between(F.col("ci_low") - 1e-12, F.col("ci_high") + 1e-12).alias("interval_holds_mean"),
                    (F.col("ci_high") - F.col("ci_low") < 1e-12).alias("interval_is_point"))


@query("failed_cases", f"""WITH {_STUDY} SELECT cohort, arm, case_id FROM ar WHERE generation_failed""")
def failed_cases(spark, sf):
    return verdicts.failed_cases(study_rows(spark, sf)).select("cohort", "arm", "case_id")


@query("study_gates", f"""WITH {_STUDY}, v AS (SELECT avg(delta) FILTER (cohort = 'en' AND arm = 'arm3') AS m, count(*) FILTER (arm = 'arm3' AND delta < -0.02) AS h, min(preservation) FILTER (arm <> 'arm1') AS p, avg(delta) FILTER (cohort = 'none') AS x FROM ar)
SELECT 'rare_mean_positive' AS name, round(m, 6) AS value, m > 0 AS passed FROM v UNION ALL SELECT 'harmful', h, h <= 1 FROM v UNION ALL SELECT 'preservation', round(p, 6), p = 1 FROM v UNION ALL SELECT 'absent_cohort', x, x > 0 FROM v""")
def study_gates(spark, sf):
    return _gates(spark, sf).select("name", r("value").alias("value"), "passed")


@query("end_to_end_gates", f"""WITH {_STUDY}, v AS (SELECT avg(delta) FILTER (cohort = 'en' AND arm = 'arm3') AS m, count(*) FILTER (arm = 'arm3' AND delta < -0.02) AS h, min(preservation) FILTER (arm <> 'arm1') AS p, avg(delta) FILTER (cohort = 'none') AS x FROM ar)
SELECT 'rare_mean_positive' AS name, round(m, 6) AS value, coalesce(m > 0, false) AS passed, m IS NULL AS no_data FROM v UNION ALL SELECT 'harmful', h, coalesce(h <= 1, false), h IS NULL FROM v
UNION ALL SELECT 'preservation', round(p, 6), coalesce(p = 1, false), p IS NULL FROM v UNION ALL SELECT 'absent_cohort', x, coalesce(x > 0, false), x IS NULL FROM v""")
def end_to_end_gates(spark, sf):
    """The form in which a gate without data fails."""
    g = _gates(spark, sf, null_fails=True)
    return g.select("name", r("value").alias("value"), "passed", (F.col("reason") == "no data").alias("no_data"))


def _gates(spark, sf, null_fails=False):
    rows = study_rows(spark, sf)
    vals = rows.agg(F.avg(F.when((F.col("cohort") == "en") & (F.col("arm") == "arm3"), F.col("delta"))).alias("m"), F.avg(F.when(F.col("cohort") == "none", F.col("delta"))).alias("x"))
    vals = vals.join(F.broadcast(verdicts.arm_totals(rows)))
    return verdicts.gate_table(vals, [("rare_mean_positive", "m", ">", 0.0), ("harmful", "harmful", "<=", 1.0), ("preservation", "preservation_min", "==", 1.0), ("absent_cohort", "x", ">", 0.0)], null_fails)


@query("study_readiness", f"""WITH {_STUDY}, v AS (SELECT avg(delta) FILTER (cohort = 'en' AND arm = 'arm3') > 0 AS a, count(*) FILTER (arm = 'arm3' AND delta < -0.02) <= 1 AS b, min(preservation) FILTER (arm <> 'arm1') = 1 AS c FROM ar)
SELECT CASE WHEN NOT a OR NOT b OR NOT c THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS readiness FROM v""")
def study_readiness(spark, sf):
    return verdicts.readiness(_gates(spark, sf))


@query("combined_readiness", """SELECT conv_id, CASE WHEN conv_id % 3 = 2 OR turn % 3 = 2 THEN 'INCONCLUSIVE' WHEN conv_id % 3 = 0 AND turn % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS readiness, turn, (conv_id % 25 = 18) OR turn = 2 AS thin FROM conversations""")
def combined_readiness(spark, sf):
    name = lambda c: F.when(F.col(c) % 3 == 0, "PASS").when(F.col(c) % 3 == 1, "FAIL").otherwise("INCONCLUSIVE")
    c = table(spark, sf, "conversations").select("conv_id", "turn", name("conv_id").alias("a"), name("turn").alias("b"), (F.col("conv_id") % 25).alias("hits"), F.lit(24).alias("total"))
    return c.select("conv_id", verdicts.combine_readiness("a", "b").alias("readiness"), "turn", verdicts.thin_pass("hits", "total", "turn").alias("thin"))


@query("assembled_arms", f"""WITH {_LABELLED} SELECT case_id, cohort, arm, CASE WHEN arm = 'arm1' OR (arm = 'arm2' AND truth_fail) OR (arm = 'arm3' AND (semantic_ok OR truth_fail)) THEN 'draft' ELSE 'attempt' END AS path, arm = 'arm2' AND truth_fail AS generation_failed
FROM lab, (VALUES ('arm1'), ('arm2'), ('arm3')) v(arm)""")
def assembled_arms(spark, sf):
    l = labelled(spark, sf).select("case_id", "cohort", (~F.col("semantic_ok") & ~F.col("truth_fail")).alias("routed"), (~F.col("truth_fail")).alias("attempt_ok"), F.lit("draft").alias("draft_path"), F.lit("attempt").alias("attempt_path"))
    return verdicts.assemble_arms(l)


@query("stratum_report", f"""WITH {_CAND}, {_WINNER}, x AS (SELECT w.case_id, CASE WHEN w.case_id % 2 = 0 THEN 'target' ELSE 'control' END AS kind, CASE WHEN w.case_id % 3 = 0 THEN 'bridge' ELSE 'common' END AS cohort,
 CASE WHEN draft_ok THEN 'healthy' WHEN winner <> 0 THEN 'repaired' ELSE 'unrepairable' END AS bucket, winner AS selected, a.dino - d.dino AS dd, a.score AS clip, w.case_id % 11 = 0 AS mask_failed, 1 - a.score / 10 AS preservation, a.dino AS dino_whole FROM w JOIN cand a ON a.case_id = w.case_id AND a.attempt = w.winner JOIN cand d ON d.case_id = w.case_id AND d.attempt = 0)
SELECT kind, cohort, count(*)::BIGINT AS n, count(*) FILTER (bucket = 'healthy')::BIGINT AS healthy, count(*) FILTER (bucket = 'repaired')::BIGINT AS repaired, count(*) FILTER (bucket = 'unrepairable')::BIGINT AS unrepairable,
 round(count(*) FILTER (bucket = 'repaired') / nullif(count(*) FILTER (bucket <> 'healthy'), 0)::DOUBLE, 9) AS repair_rate, round(avg(dd) FILTER (bucket <> 'healthy'), 6) AS dino_delta,
 count(*) FILTER (bucket <> 'healthy' AND (dd = 0 OR selected = 0))::BIGINT AS unchanged, count(*) FILTER (bucket <> 'healthy' AND selected <> 0 AND dd > 0)::BIGINT AS improved, count(*) FILTER (bucket <> 'healthy' AND selected <> 0 AND dd < 0)::BIGINT AS worsened, round(avg(clip), 6) AS clip,
 count(*) FILTER (mask_failed)::BIGINT AS mask_failed, round(avg(preservation), 6) AS preservation, round(avg(dino_whole), 6) AS dino_whole, CASE WHEN count(dd) FILTER (bucket <> 'healthy') >= 5 THEN true END AS interval_holds_mean,
 count(dd) FILTER (bucket <> 'healthy') < 5 AS underpowered
FROM x GROUP BY kind, cohort""")
def stratum_report(spark, sf):
    c = candidates(spark, sf)
    d = c.where("attempt = 0").select("case_id", F.col("dino").alias("d0"), F.col("ok").alias("draft_ok"))
    w = verdicts.select_winner(c).join(d, "case_id").join(c.select("case_id", F.col("attempt").alias("winner"), "dino", "score"), ["case_id", "winner"])
    i = F.col("case_id")
    rows = w.select(F.when(i % 2 == 0, "target").otherwise("control").alias("kind"), F.when(i % 3 == 0, "bridge").otherwise("common").alias("cohort"), verdicts.outcome("draft_ok", "winner").alias("bucket"),
                    F.col("winner").alias("selected"), (F.col("dino") - F.col("d0")).alias("dino_delta"), (i % 11 == 0).alias("mask_failed"), (1 - F.col("score") / 10).alias("preservation"), F.col("score").alias("clip"),
                    F.col("dino").alias("dino_whole"), "case_id")
    s = verdicts.stratum_report(rows)
    ints = ("n", "healthy", "repaired", "unrepairable", "unchanged", "improved", "worsened", "mask_failed")
    return s.select("kind", "cohort", *[big(x).alias(x) for x in ints], r("repair_rate", 9).alias("repair_rate"), *[r(x).alias(x) for x in ("dino_delta", "clip", "preservation", "dino_whole")],
                    F.col("dino_delta").between(F.col("ci_low") - 1e-12, F.col("ci_high") + 1e-12).alias("interval_holds_mean"), F.col("delta_verdict").isNull().alias("underpowered"))


_COHORT = f"""{_LABELLED}, cd AS (SELECT case_id AS ord, truth_fail, semantic_ok AS eligible, reference_relevance < 0.1 AS contaminated FROM lab), okc AS (SELECT *, eligible AND NOT contaminated AS ok FROM cd WHERE truth_fail),
r AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM okc)"""


@query("cohort_fill", f"""WITH {_COHORT} SELECT ord AS case_id, CASE WHEN ok THEN 'chosen' ELSE 'backfilled' END AS role, CASE WHEN (SELECT count(*) FROM okc WHERE ok) >= 24 THEN 'complete' ELSE 'inconclusive' END AS status FROM r WHERE before < 24""")
def cohort_fill(spark, sf):
    l = labelled(spark, sf).select("case_id", F.col("case_id").alias("ord"), F.when(F.col("truth_fail"), "FAIL").otherwise("PASS").alias("identity_truth"),
                                   F.col("semantic_ok").alias("eligible"), (F.col("reference_relevance") < 0.1).alias("contaminated"))
    return verdicts.select_cohort(l, "FAIL", 24).select("case_id", "role", "status")
