"""Studies that chain the operators: policy development, retrospective evaluation, holdouts, run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.functions.names import reference_query
from sorrel.functions.scores import ratio, wilson
from sorrel.operators import fitting, groups, matrix, paired, verdicts
from sorrel.operators.similarity import top_k
from sorrel.session import cut

RARE_COHORT = "bridge"


def detector_study(rows: DataFrame, reference_threshold: float, contaminated: int = 0, n_expected: int | None = None) -> dict[str, DataFrame]:
    """Leave-one-case-out detector study: folds, arms, gates, readiness.

    ``rows`` is (case_id, truth_fail, semantic_ok, text_relevance, reference_relevance).
    """
    folds = cut(fitting.loo_detector(rows))
    t = F.col("truth_fail")
    fixed = F.array(
        F.struct(F.lit("guarded").alias("arm"), F.col("predicted_fail").alias("p")),
        F.struct(F.lit("semantic_only").alias("arm"), (~F.col("semantic_ok")).alias("p")),
        F.struct(F.lit("reference_only").alias("arm"), (F.col("reference_relevance") < reference_threshold).alias("p")),
        F.struct(F.lit("union").alias("arm"), verdicts.route_reference("semantic_ok", "reference_relevance", reference_threshold).alias("p")))
    long = folds.select("truth_fail", "n", F.explode(fixed).alias("_a")).select("truth_fail", "n", "_a.*")
    arms = verdicts.weighted_confusion(long, t, F.col("p"), "n", ["arm"])
    low, high = wilson("tp", F.col("tp") + F.col("fn"))
    arms = cut(arms.withColumn("recall_low", low).withColumn("recall_high", high))
    tally = folds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_and("feasible"), F.lit(True)).cast("int").alias("all_feasible"))
    g = arms.where(F.col("arm") == "guarded").select("fp", "recall", "false_positive_rate")
    covered = F.lit(contaminated == 0) & (F.lit(True) if n_expected is None else F.col("n") == n_expected)
    values = tally.join(F.broadcast(g)).withColumn("covered", covered.cast("int")).withColumn("fp_ok", _fp_ok("fp", "false_positive_rate"))
    gates = verdicts.gate_table(values, [
        ("uncontaminated_coverage", "covered", ">=", 1), ("all_folds_feasible", "all_feasible", ">=", 1),
        ("detector_recall", "recall", ">=", fitting.MIN_RECALL), ("detector_false_positives", "fp_ok", ">=", 1)])
    ready = gates.agg(F.bool_and(F.when(F.col("name") == "uncontaminated_coverage", F.col("passed"))).alias("_c"), F.bool_and("passed").alias("_p")).select(
        F.when(~F.col("_c"), "INCONCLUSIVE").when(F.col("_p"), "PASS").otherwise("FAIL").alias("readiness"))
    return {"folds": folds, "arms": arms, "gates": gates, "readiness": ready}


def _fp_ok(fp: str, rate: str):
    return ((F.col(fp) <= fitting.MAX_HARMFUL) | (F.col(rate) <= fitting.MAX_FP_RATE)).cast("int")


def selector_study(candidates: DataFrame, cohorts: DataFrame, judged: bool = False, n_boot: int = 10_000) -> dict[str, DataFrame]:
    """Leave-one-case-out selector study: margins and selection per case, quality, cohort intervals."""
    margins = cut(fitting.loo_selector(candidates, judged))
    cases = cut(fitting.apply_margins(candidates, margins, judged).join(cohorts.select("case_id", "cohort"), "case_id"))
    quality = cases.agg(
        F.sum("n_pairs").alias("comparisons"), ratio(F.sum("right_pairs"), F.sum("n_pairs")).alias("sign_accuracy"),
        F.count_if(F.col("dino_delta") < fitting.HARM_MARGIN).alias("harmful"), F.avg("dino_delta").alias("mean_delta"), F.avg(F.col("exact").cast("int")).alias("exact_best_rate"))
    d = F.col("dino_delta")
    signs = cases.groupBy("cohort").agg(F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("worsened"))
    by_cohort = paired.bootstrap_ci(cases, ["cohort"], "dino_delta", n_boot=n_boot, ident="case_id").join(signs, "cohort")
    return {"margins": margins, "cases": cases, "quality": quality, "cohorts": by_cohort}


def development_study(rows: DataFrame, candidates: DataFrame, cohorts: DataFrame, reference_threshold: float, judged: bool = False,
                      rare: str = RARE_COHORT, n_boot: int = 10_000) -> dict[str, DataFrame]:
    """Detector and selector folds together with the five readiness gates, and both fits on all rows."""
    det, sel = detector_study(rows, reference_threshold), selector_study(candidates, cohorts, judged, n_boot)
    g = det["arms"].where(F.col("arm") == "guarded").select("recall", _fp_ok("fp", "false_positive_rate").alias("fp_ok"))
    q = sel["quality"].select("sign_accuracy", "harmful")
    m = sel["cases"].agg(F.avg(F.when(F.col("cohort") == rare, F.col("dino_delta"))).alias("rare_mean"))
    values = g.join(F.broadcast(q)).join(F.broadcast(m))
    gates = verdicts.gate_table(values, [
        ("detector_recall", "recall", ">=", fitting.MIN_RECALL), ("detector_false_positives", "fp_ok", ">=", 1),
        ("selector_sign_accuracy", "sign_accuracy", ">=", fitting.MIN_SIGN_ACCURACY), ("selector_harmful", "harmful", "<=", fitting.MAX_HARMFUL),
        ("rare_mean_delta", "rare_mean", ">", 0.0)])
    return {"detector": det["arms"], "folds": det["folds"], "margins": sel["margins"], "cases": sel["cases"], "quality": sel["quality"], "cohorts": sel["cohorts"],
            "gates": gates, "readiness": verdicts.readiness(gates), "detector_policy": fitting.fit_detector(rows), "selector_policy": fitting.fit_selector(candidates, judged)}


def _signs(candidates: DataFrame, cases: DataFrame, text_margin: float) -> DataFrame:
    """Attempts of the cases compared with their draft, and the share of which eligibility agrees with the better answer."""
    draft = candidates.where(F.col("attempt") == 0).select(
        "case_id", F.col("text_relevance").alias("_dt"), F.col("reference_relevance").alias("_dr"), F.col("dino").alias("_dd"))
    j = candidates.where(F.col("attempt") > 0).join(draft, "case_id").join(cases.select("case_id"), "case_id", "left_semi")
    eligible = (F.col("text_relevance") - F.col("_dt") + 1e-12 >= text_margin) & (F.col("reference_relevance") - F.col("_dr") > 0)
    right = F.count_if(eligible == (F.col("dino") > F.col("_dd")))
    return j.agg(F.count(F.lit(1)).alias("comparisons"), ratio(right, F.count(F.lit(1))).alias("sign_accuracy"))


def _retrospective_gates(cases: DataFrame, detector: DataFrame, selector: DataFrame) -> DataFrame:
    """(name, passed, reason): the detector fails for want of a stratum, recall or precision, the selector of signs or harm."""
    strata = cases.agg(F.count_if("truth_fail").alias("_f"), F.count_if(~F.col("truth_fail")).alias("_p"))
    union = detector.where(F.col("arm") == "union").select("recall", "fp")
    one = strata.join(F.broadcast(selector)).join(F.broadcast(union), how="left")
    reason = F.when(F.col("_f") == 0, "missing FAIL stratum").when(F.col("_p") == 0, "missing PASS stratum")
    found = F.coalesce(reason.isNull() & (F.col("recall") >= fitting.MIN_RECALL) & (F.col("fp") <= 1), F.lit(False))
    chosen = F.coalesce((F.col("comparisons") > 0) & (F.col("sign_accuracy") >= fitting.MIN_SIGN_ACCURACY) & (F.col("harmful") <= fitting.MAX_HARMFUL), F.lit(False))
    gates = F.array(F.struct(F.lit("detector").alias("name"), found.alias("passed"), reason.alias("reason")),
                    F.struct(F.lit("selector").alias("name"), chosen.alias("passed"), F.lit(None).cast("string").alias("reason")))
    return one.select(F.explode(gates).alias("_g")).select("_g.*")


def retrospective(rows: DataFrame, candidates: DataFrame, reference_threshold: float, text_margin: float, n_boot: int = 10_000) -> dict[str, DataFrame]:
    """A fixed policy on past cases: routed by judge or low reference, repaired only when routed.

    Excluded and blank truths must be left out beforehand; ``rows`` adds cohort. The selector counts
    how often eligibility agrees with the better answer, over every attempt of every case.
    """
    routed = rows.withColumn("routed", verdicts.route_reference("semantic_ok", "reference_relevance", reference_threshold))
    chosen = verdicts.select_repair(candidates, text_margin, 0.0, strict_reference=True)
    draft = candidates.where(F.col("attempt") == 0).select("case_id", F.col("dino").alias("_d0"))
    oracle = candidates.groupBy("case_id").agg(F.min_by("attempt", F.struct(-F.col("dino"), F.col("attempt"))).alias("oracle"))
    picked = routed.join(chosen, "case_id").withColumn("selected", F.when(F.col("routed"), F.col("selected")).otherwise(F.lit(0)))
    answer = candidates.select("case_id", F.col("attempt").alias("selected"), "dino")
    cases = cut(picked.join(answer, ["case_id", "selected"]).join(draft, "case_id").join(oracle, "case_id").select(
        "case_id", "cohort", "truth_fail", "semantic_ok", "reference_relevance", "routed", "selected", "oracle", (F.col("dino") - F.col("_d0")).alias("dino_delta")))
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), p.alias("p")) for n, p in (
        ("semantic", ~F.col("semantic_ok")), ("reference", F.col("reference_relevance") < reference_threshold), ("union", F.col("routed")))])
    detector = verdicts.confusion(cases.select("truth_fail", F.explode(arms).alias("_a")).select("truth_fail", "_a.*"), F.col("truth_fail"), F.col("p"), ["arm"])
    d = F.col("dino_delta")
    selector = cases.agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col("selected") == F.col("oracle")).cast("int")).alias("exact_best"),
                         F.avg(d).alias("mean_delta"), F.count_if(d < fitting.HARM_MARGIN).alias("harmful"))
    selector = selector.join(F.broadcast(_signs(candidates, cases, text_margin)))
    cohorts = cases.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("improved"),
                                          F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("worsened"))
    interval = paired.bootstrap_ci(cases, ["cohort"], "dino_delta", n_boot=n_boot, ident="case_id").select("cohort", "ci_low", "ci_high")
    return {"cases": cases, "detector": detector, "selector": selector, "cohorts": cohorts.join(interval, "cohort", "left"),
            "gates": _retrospective_gates(cases, detector, selector)}


def holdout(candidates: DataFrame, references: DataFrame, reserves: DataFrame, needed: int = 24) -> dict[str, DataFrame]:
    """A frozen holdout of ``needed`` rare FAIL and control PASS cases, references apart from reserves.

    ``candidates`` is (ord, case_id, cohort, identity_truth, eligible, contaminated);
    ``problems`` has an error for a short cohort and for each reference also held in reserve.
    """
    from sorrel.operators.guards import union_all, violation

    parts = [verdicts.select_cohort(candidates.where(F.col("cohort") == c), want, needed).withColumn("cohort", F.lit(c)) for c, want in (("rare", "FAIL"), ("control", "PASS"))]
    picked = cut(union_all(parts))
    chosen = picked.where(F.col("role") == "chosen")
    names = candidates.sparkSession.range(1).select(F.explode(F.array(F.lit("rare"), F.lit("control"))).alias("cohort"))
    short = names.join(chosen.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")), "cohort", "left").where(F.coalesce("n", F.lit(0)) != needed)
    shared = references.join(reserves.select("case_id", "path"), ["case_id", "path"], "left_semi").join(chosen.select("case_id"), "case_id", "left_semi")
    problems = union_all([
        violation(short, "error", "short_cohort", "cohort", F.concat(F.lit("fewer cases than needed in "), F.col("cohort"))),
        violation(shared, "error", "reference_in_reserve", "case_id", F.concat(F.lit("reference also held in reserve: "), F.col("path")))])
    keep = lambda d: d.join(chosen.select("case_id"), "case_id", "left_semi")
    return {"cases": picked, "references": keep(references), "reserves": keep(reserves), "problems": problems}


def run_report(plan: DataFrame, tables: list[DataFrame], metrics: list[str], part_tree: bool = False) -> dict[str, DataFrame]:
    """Merged scores, best seed per cell, means per method, paired delta and missing cells of a run."""
    scores = matrix.merge_tables(tables)
    rows, missing = matrix.best_seeds(plan, scores, metrics, part_tree)
    rows = cut(rows)
    return {"rows": rows, "missing": missing, "means": paired.numeric_means(rows.drop("seed"), "method"),
            "coverage": matrix.completeness(plan, scores, "image_id")}


def retrieved_prototypes(phrases: DataFrame, embedded: DataFrame, corpus: DataFrame, k: int = 8) -> DataFrame:
    """Prototype per phrase: the normalised mean of its ``k`` nearest corpus vectors.

    ``phrases`` is (phrase, coarse); ``embedded`` the caller's text vectors (query, vec) of
    ``phrase_queries``; ``corpus`` (doc_id, vec).
    """
    q = phrase_queries(phrases).join(embedded, "query").select(F.col("phrase").alias("query_id"), "vec")
    hits = top_k(q, corpus, k).select(F.col("query_id").alias("phrase"), "doc_id")
    return groups.centroids(hits.join(corpus, "doc_id"), ["phrase"], "vec")


def phrase_queries(phrases: DataFrame) -> DataFrame:
    return phrases.select("phrase", reference_query("phrase", "coarse").alias("query"))
