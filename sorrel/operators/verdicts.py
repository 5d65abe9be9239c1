"""Verifier evaluation: states, fusion, routing, confusion reports, sweeps, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.scores import confusion_metrics, counts, finite, finite_score, ratio, wilson

# fixed values
FAILING_STATES = ("MISSING", "FINE_MISMATCH")
TAU_GRID = tuple(round(0.01 * i, 2) for i in range(1, 100))
DELTA_GRID = tuple(round(0.005 * i, 3) for i in range(-40, 41))
DELTA_OFF = -1.0
BASELINE_TAU = 0.25


def state_at(sim: Column, margin: Column, tau, delta) -> Column:
    """ABSTAIN without a similarity, MISSING below tau, FINE_MISMATCH below delta, else PRESENT."""
    tau, delta = (c if isinstance(c, Column) else F.lit(c) for c in (tau, delta))
    return (F.when(sim.isNull(), "ABSTAIN").when(sim < tau, "MISSING")
            .when(margin.isNotNull() & (F.bround(margin, 9) < delta), "FINE_MISMATCH").otherwise("PRESENT"))


def prototype_margin(candidates: str) -> Column:
    """Margin at the most confident candidate carrying both prototype scores, first on ties."""
    scored = F.filter(F.col(candidates), lambda c: c["sim_proto"].isNotNull() & c["sim_proto_coarse"].isNotNull())
    best = F.aggregate(
        scored, F.lit(None).cast("struct<conf:double,margin:double>"),
        lambda s, c: F.when(s.isNull() | (c["dino_conf"] > s["conf"]), F.struct(
            c["dino_conf"].cast("double").alias("conf"),
            (c["sim_proto"] - c["sim_proto_coarse"]).cast("double").alias("margin"))).otherwise(s))
    return best["margin"]


def select_box(df: DataFrame, case: Sequence[str], ident: str, conf: str = "dino_conf", proto: str = "sim_proto") -> DataFrame:
    """Chosen candidate per case and the rule used.

    Nearest prototype when two or more candidates carry a prototype score, otherwise the
    highest detector confidence; lowest id on ties.
    """
    first = lambda score: F.min_by(F.col(ident), F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(ident))))
    per = df.groupBy(*case).agg(F.count(proto).alias("_np"), first(conf).alias("_by_conf"), first(proto).alias("_by_proto"))
    rule = F.when(F.col("_np") >= 2, "prototype").otherwise("confidence")
    return per.select(*case, F.when(F.col("_np") >= 2, F.col("_by_proto")).otherwise(F.col("_by_conf")).alias(ident), rule.alias("rule"))


def fuse(scores: DataFrame, semantic: DataFrame) -> DataFrame:
    """One verdict per case from concept scores (case_id, phrase, sim, state) and (case_id, ok, first_issue).

    Fails when either branch fails. The target is the failing concept of lowest similarity,
    else the judge's first issue; the score is the lowest similarity seen, NULL when none.
    """
    failing = F.col("state").isin(*FAILING_STATES)
    per = scores.groupBy("case_id").agg(
        F.bool_or(failing).alias("grounded_failed"),
        F.min_by("phrase", F.when(failing, F.struct(F.coalesce("sim", F.lit(0.0)), F.col("phrase")))).alias("_low"),
        F.min(F.when(F.col("state") != "ABSTAIN", F.col("sim"))).alias("score"))
    j = semantic.join(per, "case_id", "left").withColumn("grounded_failed", F.coalesce("grounded_failed", F.lit(False)))
    g, s = F.col("grounded_failed"), ~F.col("ok")
    return j.select(
        "case_id", (~g & ~s).alias("ok"),
        F.when(g & s, "BOTH_FAIL").when(g, "GROUNDED_ONLY").when(s, "SEMANTIC_ONLY").otherwise("BOTH_PASS").alias("agreement"),
        F.when(g, F.col("_low")).when(s, F.col("first_issue")).alias("target"), "score")


def route_reference(semantic_ok, reference, threshold: float) -> Column:
    """Route when the judge fails or reference relevance is low."""
    return ~F.col(semantic_ok) | (F.col(reference) < threshold)


def route_guarded(semantic_ok, text, reference, text_threshold, reference_threshold) -> Column:
    """Route when the judge fails, or both relevances are low; a non-finite score is an error."""
    tt, rt = (c if isinstance(c, Column) else F.lit(c) for c in (text_threshold, reference_threshold))
    rule = ~F.col(semantic_ok) | ((F.col(text) < tt) & (F.col(reference) < rt))
    return F.when(finite(text) & finite(reference), rule).otherwise(
        F.raise_error(F.concat(F.lit("non-finite score: "), F.concat_ws("/", F.col(text).cast("string"), F.col(reference).cast("string")))).cast("boolean"))


def full_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: whether every row has finite scores (true on empty input)."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(c)
    return df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("covered"))


def confusion(df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = (), empty=0.0) -> DataFrame:
    """Counts and ratios per key; positive means FAIL."""
    c = df.groupBy(*keys).agg(*counts(truth, predicted))
    return c.select(*keys, "tp", "fp", "tn", "fn", *[m.alias(n) for n, m in confusion_metrics(empty).items()])


def weighted_confusion(df: DataFrame, truth: Column, predicted: Column, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion of rows that stand for ``weight`` equal ones."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0))
    c = df.groupBy(*keys).agg(part(truth & predicted).alias("tp"), part(~truth & predicted).alias("fp"),
                              part(~truth & ~predicted).alias("tn"), part(truth & ~predicted).alias("fn"))
    return c.select(*keys, "tp", "fp", "tn", "fn", *[m.alias(n) for n, m in confusion_metrics().items()])


def three_way_confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FAIL verdicts are positive, PASS and ABSTAIN negative; empty ratios are NaN, MCC 0."""
    nan = float("nan")
    c = df.groupBy(*keys).agg(*counts(F.col("label") == "fail", F.col("verdict") == "FAIL"),
                              F.count_if(F.col("verdict") == "ABSTAIN").alias("n_abstain"))
    m = confusion_metrics(nan)
    return c.select(*keys, "tp", "fp", "tn", "fn", m["recall"].alias("recall"), m["false_positive_rate"].alias("fp_rate"),
                    m["mcc"].alias("mcc"), m["accuracy"].alias("accuracy"), "n_abstain", m["n"].alias("n"))


def apply_frozen(df: DataFrame, text_threshold: float, reference_threshold: float) -> tuple[DataFrame, DataFrame]:
    """Per-case routing under fixed thresholds, and the confusion per cohort."""
    cases = df.select("case_id", "cohort", "truth_fail", route_guarded(
        "semantic_ok", "text_relevance", "reference_relevance", text_threshold, reference_threshold).alias("routed"))
    return cases, confusion(cases, F.col("truth_fail"), F.col("routed"), ["cohort"])


def ground_truth(labels: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows with ``is_fail``, and one row counting kept and excluded blanks.

    A verdict outside pass, fail and blank is an error naming the case.
    """
    v = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    checked = labels.withColumn("_v", F.when(v.isin("pass", "fail", ""), v).otherwise(
        F.raise_error(F.concat(F.lit("case "), F.col("case_id").cast("string"), F.lit(": unexpected verdict "), v)).cast("string")))
    kept = checked.where(F.col("_v") != "").withColumn("is_fail", F.col("_v") == "fail").drop("_v")
    tally = checked.agg(F.count_if(F.col("_v") != "").alias("kept"), F.count_if(F.col("_v") == "").alias("excluded"))
    return kept, tally


def verifier_report(kept: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary with Wilson intervals, per-case table) of hard decisions (case_id, ok)."""
    missing = F.raise_error(F.concat(F.lit("missing decision for case "), F.col("case_id").cast("string"))).cast("boolean")
    j = kept.join(decisions, "case_id", "left").withColumn("_fail", F.when(F.col("ok").isNull(), missing).otherwise(~F.col("ok")))
    t, p = F.col("is_fail"), F.col("_fail")
    cases = j.select("case_id", t.alias("truth_fail"), p.alias("decision_fail"), (t == p).alias("correct"),
                     (t & ~p).alias("false_negative"), (~t & p).alias("false_positive"))
    c = confusion(j, t, p)
    (rl, rh), (sl, sh) = wilson("tp", F.col("tp") + F.col("fn")), wilson("tn", F.col("tn") + F.col("fp"))
    return c.select("*", rl.alias("recall_low"), rh.alias("recall_high"), sl.alias("specificity_low"), sh.alias("specificity_high")), cases


def constant_baselines(df: DataFrame, truth: Column) -> DataFrame:
    """The two constant verifiers, always FAIL and always PASS."""
    both = df.withColumn("_arm", F.explode(F.array(
        F.struct(F.lit("always-FAIL").alias("arm"), F.lit(True).alias("p")),
        F.struct(F.lit("always-PASS").alias("arm"), F.lit(False).alias("p"))))).withColumn("arm", F.col("_arm.arm")).withColumn("_p", F.col("_arm.p"))
    return confusion(both, truth, F.col("_p"), ["arm"])



def sweep_tau(scores: DataFrame, cases: DataFrame, grid: Sequence[float] = TAU_GRID) -> DataFrame:
    """Per tau and arm, the confusion and abstain rate. ``cases`` has (case_id, is_fail, ok).

    With the margin test off a case fails at tau exactly when its lowest similarity is
    below it, so cases reduce to one number before meeting the grid.
    """
    low = scores.groupBy("case_id").agg(F.min("sim").alias("_low"))
    total = scores.agg(ratio(F.count_if(F.col("sim").isNull()), F.count(F.lit(1))).alias("abstain_rate"))
    j = cases.join(low, "case_id", "left")
    g = _over_grid(j, ["is_fail", "ok"], "_low", grid, "tau")
    return _arm_confusions(g, "tau", F.col("_reached")).join(F.broadcast(total))


def _over_grid(rows: DataFrame, keys: Sequence[str], level: str, grid: Sequence[float], name: str) -> DataFrame:
    """Weighted rows (keys, grid value, _reached, _w): whether ``level`` lies below each grid value.

    A row is put into its cell of the grid once and rows of a cell are counted together, so
    only keys times grid cells meet the grid. NULL and NaN levels are below nothing.
    """
    grid = sorted(float(t) for t in grid)
    points = F.array(*[F.lit(t) for t in grid])
    cell = F.when(F.col(level).isNull(), len(grid)).otherwise(F.size(F.filter(points, lambda t: ~(F.col(level) < t))))
    counted = rows.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_w"))
    return counted.select(*keys, "_cell", "_w", F.posexplode(points).alias("_at", name)).withColumn("_reached", F.col("_at") >= F.col("_cell"))


def _arm_confusions(g: DataFrame, grid_col: str, grounded: Column) -> DataFrame:
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), p.alias("p")) for n, p in (
        ("grounded", grounded), ("semantic", ~F.col("ok")), ("fused", grounded | ~F.col("ok")))])
    long = g.select(grid_col, "is_fail", "_w", F.explode(arms).alias("_a"))
    t, p, w = F.col("is_fail"), F.col("_a.p"), F.col("_w")
    part = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    c = long.groupBy(grid_col, F.col("_a.arm").alias("arm")).agg(
        part(t & p).alias("tp"), part(~t & p).alias("fp"), part(~t & ~p).alias("tn"), part(t & ~p).alias("fn"))
    return c.select(grid_col, "arm", "tp", "fp", "tn", "fn", *[m.alias(n) for n, m in confusion_metrics().items()])


def case_fail_level(scores: DataFrame, margin: Column, tau: float) -> DataFrame:
    """Per case: whether some concept is MISSING at tau, and the lowest margin of the others."""
    present = F.coalesce(F.col("sim") >= tau, F.lit(False))
    return scores.groupBy("case_id").agg(
        F.coalesce(F.bool_or(F.col("sim") < tau), F.lit(False)).alias("missing"),
        F.min(F.when(present, F.bround(margin, 9))).alias("low_margin"))


def sweep_delta(scores: DataFrame, cases: DataFrame, margin: Column, tau: float = BASELINE_TAU,
                grid: Sequence[float] = DELTA_GRID) -> DataFrame:
    """Per delta and arm, the confusion at a pinned tau; same reduction as the tau sweep."""
    j = cases.join(case_fail_level(scores, margin, tau), "case_id", "left")
    g = _over_grid(j, ["is_fail", "ok", "missing"], "low_margin", grid, "delta")
    grounded = F.coalesce(F.col("missing"), F.lit(False)) | F.col("_reached")
    return _arm_confusions(g, "delta", grounded)


def best_grid_point(sweep: DataFrame, grid_col: str, metric: str = "balanced_accuracy") -> DataFrame:
    """Grid value of the highest metric per arm, lowest value on ties."""
    return sweep.groupBy("arm").agg(F.max_by(grid_col, F.struct(F.col(metric), -F.col(grid_col))).alias(f"best_{grid_col}"))


def baseline_split(scores: DataFrame, cases: DataFrame, margin: Column, tau: float = BASELINE_TAU) -> DataFrame:
    """Per case, its part with the margin test off: caught, missed, inherited_fp or clean."""
    j = cases.join(case_fail_level(scores, margin, tau), "case_id", "left")
    fails = F.coalesce("missing", F.lit(False)) | ~F.col("ok")
    return j.select("case_id", "is_fail", "ok", "missing", "low_margin", F.when(F.col("is_fail") & fails, "caught").when(
        F.col("is_fail"), "missed").when(fails, "inherited_fp").otherwise("clean").alias("part"))


def evaluate_rule(split: DataFrame, grid: Sequence[float] = DELTA_GRID, min_catch: int = 4) -> DataFrame:
    """Per delta: newly caught, new false positives, old catches retained, and the verdict."""
    g = _over_grid(split, ["part", "ok", "missing"], "low_margin", grid, "delta")
    fails = F.coalesce("missing", F.lit(False)) | ~F.col("ok") | F.col("_reached")
    tally = lambda cond: F.sum(F.when(cond, F.col("_w")).otherwise(0))
    out = g.groupBy("delta").agg(
        tally((F.col("part") == "missed") & fails).alias("caught"),
        tally((F.col("part") == "clean") & fails).alias("new_false_positives"),
        (tally((F.col("part") == "caught") & ~fails) == 0).alias("retained"))
    return out.withColumn("passes", (F.col("caught") >= min_catch) & (F.col("new_false_positives") == 0) & F.col("retained"))


def robust_band(results: DataFrame, order: str, passes: str = "passes", min_run: int = 3) -> DataFrame:
    """Rows of the longest run of consecutive passes, the earliest on ties, none if too short.

    The input is one row per grid point, so its size is the grid's.
    """
    w = Window.orderBy(order)
    marked = results.withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy(passes).orderBy(order)))
    runs = marked.where(F.col(passes)).groupBy("_i").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_from"))
    best = runs.where(F.col("_n") >= min_run).orderBy(F.col("_n").desc(), "_from").limit(1).select("_i", F.lit(True).alias(passes))
    return marked.join(F.broadcast(best), ["_i", passes], "left_semi").drop("_i")


def crosstab(cases: DataFrame) -> DataFrame:
    """Over true failures: caught by both branches, one of them, or neither."""
    m, s = F.col("verdict") == "FAIL", ~F.coalesce("semantic_ok", F.lit(True))
    return cases.where(F.col("label") == "fail").agg(
        F.count_if(m & s).alias("both"), F.count_if(m & ~s).alias("verifier_only"),
        F.count_if(~m & s).alias("semantic_only"), F.count_if(~m & ~s).alias("neither"))


# --- choice among candidates ---------------------------------------------------

def select_winner(candidates: DataFrame, case: str = "case_id") -> DataFrame:
    """Winner per case of rows (case, attempt, ok, score), attempt 0 being the draft.

    A passing draft wins, else the first passing attempt, else the highest score with the
    draft in the running; no score never wins, an equal score never displaces an earlier one.
    """
    a, s = F.col("attempt"), F.col("score")
    per = candidates.groupBy(case).agg(
        F.bool_or((a == 0) & F.col("ok")).alias("_d"), F.min(F.when((a > 0) & F.col("ok"), a)).alias("_p"),
        F.min_by(a, F.when(s.isNotNull() & ~F.isnan(s), F.struct(-s, a))).alias("_s"))
    return per.select(case, F.when(F.col("_d"), 0).when(F.col("_p").isNotNull(), F.col("_p")).otherwise(
        F.coalesce("_s", F.lit(0))).cast("long").alias("winner"))


def outcome(draft_ok, winner) -> Column:
    """healthy, repaired or unrepairable."""
    return F.when(F.col(draft_ok), "healthy").when(F.col(winner) != 0, "repaired").otherwise("unrepairable")


def status_for(draft_ok, winner) -> Column:
    """Queue status of a chosen candidate: repaired, healthy or unrepaired."""
    return F.when(F.col(winner) != 0, "repaired").when(F.col(draft_ok), "healthy").otherwise("unrepaired")


def select_repair(candidates: DataFrame, text_margin: float, reference_margin: float | None = None, *, case: str = "case_id",
                  judged: bool = False, strict_reference: bool = False) -> DataFrame:
    """Best eligible attempt per case of (case, attempt, text_relevance, reference_relevance, semantic_ok).

    Eligible: gains over the draft reach the inclusive margins (``strict_reference`` asks for
    a reference gain above its margin), and the judge accepts it when ``judged``. Best by
    text, then reference (unless judged), then lower attempt; else 0.
    """
    ulp = 1e-12
    # both signals are checked for every attempt, so a broken score can neither win nor pass for a rejection
    candidates = candidates.withColumns({c: finite_score(c) for c in ("text_relevance", "reference_relevance")})
    draft = candidates.where(F.col("attempt") == 0).select(
        case, F.col("text_relevance").alias("_dt"), F.col("reference_relevance").alias("_dr"))
    j = candidates.where(F.col("attempt") > 0).join(draft, case)
    ok = F.col("text_relevance") - F.col("_dt") + ulp >= text_margin
    if reference_margin is not None:
        gain = F.col("reference_relevance") - F.col("_dr")
        ok = ok & (gain > reference_margin if strict_reference else gain + ulp >= reference_margin)
    if judged:
        ok = ok & F.coalesce("semantic_ok", F.lit(False))
    rank = [F.col("text_relevance")] + ([] if judged else [F.col("reference_relevance")]) + [-F.col("attempt")]
    best = j.where(ok).groupBy(case).agg(F.max_by("attempt", F.struct(*rank)).alias("_a"))
    return draft.select(case).join(best, case, "left").select(case, F.coalesce("_a", F.lit(0)).cast("long").alias("selected"))


def pick_best(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Prefer ok, then the highest score, then the lowest id."""
    return df.groupBy(*keys).agg(F.min_by(ident, F.struct(
        (~F.col("ok")).alias("bad"), F.when(F.col("score").isNull(), 1).otherwise(0).alias("none"), (-F.col("score")).alias("neg"), F.col(ident))).alias(ident))


def eligibility(mask_failed, mask_present, n_attempts) -> Column:
    return (F.when(F.col(mask_failed), "mask_not_grounded").when(~F.coalesce(F.col(mask_present), F.lit(False)), "corrupt_artifact")
            .when(F.coalesce(F.col(n_attempts), F.lit(0)) == 0, "no_prepared_reference").otherwise("eligible"))


def rounds_for(budget: int, n_references) -> Column:
    return F.least(F.lit(budget), F.col(n_references))


def pairwise_quality(candidates: DataFrame, feature: str, answer: str, *, case: str = "case_id", harm: float = -0.02,
                     keep_draft_on_tie: bool = True) -> DataFrame:
    """Selector quality of one feature against held-out answers.

    Sign agreement of feature gain and answer delta over attempts; the selected candidate
    (draft unless some attempt scores higher) against the oracle; harm and mean delta.
    """
    rows = candidates.where(F.col(feature).isNotNull() & F.col(answer).isNotNull())
    d = rows.where(F.col("attempt") == 0).select(case, F.col(feature).alias("_df"), F.col(answer).alias("_da"))
    j = rows.join(d, case)
    att = F.col("attempt") > 0
    top = lambda c: F.min_by(F.struct("attempt", answer), F.struct(-F.col(c), F.col("attempt")))
    per = j.groupBy(case).agg(
        F.count_if(att).alias("_n"), F.count_if(att & ((F.col(feature) > F.col("_df")) == (F.col(answer) > F.col("_da")))).alias("_right"),
        top(feature).alias("_sel"), top(answer).alias("_best"), F.first("_da").alias("_da")).where(F.col("_n") > 0)
    delta = F.col("_sel")[answer] - F.col("_da")
    return per.agg(
        F.sum("_n").alias("comparisons"), ratio(F.sum("_right"), F.sum("_n")).alias("sign_accuracy"), F.count(F.lit(1)).alias("cases"),
        F.avg((F.col("_sel.attempt") == F.col("_best.attempt")).cast("int")).alias("exact_oracle"),
        F.avg(delta).alias("mean_delta"), F.count_if(delta < harm).alias("harmful"))


# --- reports and gates -----------------------------------------------------------

def arm_report(rows: DataFrame, n_boot: int = 10_000) -> DataFrame:
    """Per cohort and arm: n, mean delta with its interval, whole scores, preservation floor, signs, failures.

    The interval (``ci_low``, ``ci_high``) is that of ``bootstrap_ci``: NULL below five deltas.
    """
    from sorrel.operators.paired import bootstrap_ci

    d = F.col("delta")
    interval = bootstrap_ci(rows, ["cohort", "arm"], "delta", n_boot=n_boot, ident="case_id").select("cohort", "arm", "ci_low", "ci_high")
    return rows.groupBy("cohort", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.avg("whole_clip").alias("whole_clip"),
        F.avg("whole_siglip").alias("whole_siglip"), F.min("preservation").alias("preservation_min"),
        F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("worsened"),
        F.count_if(F.coalesce("generation_failed", F.lit(False))).alias("generation_failed")).join(interval, ["cohort", "arm"], "left")


def failed_cases(rows: DataFrame) -> DataFrame:
    """(cohort, arm, case_id) of the rows whose generation failed."""
    return rows.where(F.coalesce("generation_failed", F.lit(False))).select("cohort", "arm", "case_id")


def arm_totals(rows: DataFrame, harm: float = -0.02) -> DataFrame:
    """Harmful count of the routed arm and the preservation floor off the draft arm."""
    return rows.agg(F.count_if((F.col("arm") == "arm3") & (F.col("delta") < harm)).alias("harmful"),
                    F.min(F.when(F.col("arm") != "arm1", F.col("preservation"))).alias("preservation_min"))


def assemble_arms(cases: DataFrame) -> DataFrame:
    """Three rows per case: draft, attempt with flagged fallback, routed attempt.

    A failed attempt on a routed case makes the whole study invalid: an error.
    """
    routed, ok = F.col("routed"), F.col("attempt_ok")
    guard = F.when(routed & ~ok, F.raise_error(F.concat(F.lit("routed attempt failed: "), F.col("case_id").cast("string"))).cast("boolean")).otherwise(F.lit(False))
    arm = lambda name, path, failed: F.struct(F.lit(name).alias("arm"), path.alias("path"), failed.alias("generation_failed"))
    draft, attempt = F.col("draft_path"), F.col("attempt_path")
    arms = F.array(arm("arm1", draft, F.lit(False)), arm("arm2", F.when(ok, attempt).otherwise(draft), ~ok),
                   arm("arm3", F.when(routed & ok, attempt).otherwise(draft), guard))
    return cases.select("case_id", "cohort", F.explode(arms).alias("_a")).select("case_id", "cohort", "_a.*")


#: Further scores of a stratum whose means are reported where the rows have them.
STRATUM_SCORES = ("dino_cropped", "dino_cropped_draft", "dino_whole", "siglip")


def stratum_report(rows: DataFrame, n_boot: int = 10_000) -> DataFrame:
    """Per kind and cohort: outcome counts, repair rate over needed cases, means over their own rows.

    The mean delta of needed cases comes with its interval and the harm verdict on it (both
    NULL below five).
    """
    from sorrel.operators.paired import bootstrap_ci, harm_verdict

    needed = rows.where((F.col("bucket") != "healthy") & F.col("dino_delta").isNotNull())
    interval = bootstrap_ci(needed, ["kind", "cohort"], "dino_delta", n_boot=n_boot, ident="case_id").select("kind", "cohort", "ci_low", "ci_high")
    need = F.col("bucket") != "healthy"
    acted = need & (F.col("selected") != 0)
    d = F.col("dino_delta")
    n_rep, n_un = F.count_if(F.col("bucket") == "repaired"), F.count_if(F.col("bucket") == "unrepairable")
    return rows.groupBy("kind", "cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(need, d)).alias("n_delta"), F.count_if(~need).alias("healthy"),
        n_rep.alias("repaired"), n_un.alias("unrepairable"), F.count_if(F.coalesce("mask_failed", F.lit(False))).alias("mask_failed"),
        ratio(n_rep, n_rep + n_un, None).alias("repair_rate"), F.avg(F.when(need, d)).alias("dino_delta"),
        F.count_if(need & (F.coalesce(d == 0, F.lit(False)) | (F.col("selected") == 0))).alias("unchanged"),
        F.count_if(acted & (d > 0)).alias("improved"), F.count_if(acted & (d < 0)).alias("worsened"),
        F.avg("preservation").alias("preservation"), F.avg("clip").alias("clip"),
        *[F.avg(c).alias(c) for c in STRATUM_SCORES if c in rows.columns]).join(
            interval, ["kind", "cohort"], "left").withColumn("delta_verdict", harm_verdict("ci_low", "ci_high"))


def gate_table(values: DataFrame, gates: Sequence[tuple[str, str, str, float]], null_fails: bool = False) -> DataFrame:
    """Long gate rows (name, value, threshold, passed) from a one-row frame.

    A gate is (name, value column, operator among >=, <=, >, ==, threshold); a NULL value
    leaves ``passed`` NULL, or fails the gate with ``null_fails``.
    """
    ops = {">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t, ">": lambda v, t: v > t, "==": lambda v, t: v == t}
    cells = [F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"),
                      ops[o](F.col(c).cast("double"), F.lit(float(t))).alias("passed")) for n, c, o, t in gates]
    table = values.select(F.explode(F.array(*cells)).alias("_g")).select("_g.*")
    if null_fails:
        table = table.withColumn("passed", F.coalesce("passed", F.lit(False)))
    return table.withColumn("reason", F.when(F.col("value").isNull(), "no data").when(F.col("passed"), "ok").otherwise(
            F.concat(F.col("name"), F.lit(" out of bounds"))))


def readiness(gates: DataFrame) -> DataFrame:
    """FAIL if any gate fails, else INCONCLUSIVE if any is undecided, else PASS."""
    return gates.agg(F.when(F.bool_or(~F.col("passed")), "FAIL").when(
        F.count_if(F.col("passed").isNull()) > 0, "INCONCLUSIVE").otherwise("PASS").alias("readiness"))


def combine_readiness(first, second) -> Column:
    a, b = F.col(first), F.col(second)
    return (F.when((a == "INCONCLUSIVE") | (b == "INCONCLUSIVE"), "INCONCLUSIVE")
            .when((a == "PASS") & (b == "PASS"), "PASS").otherwise("FAIL"))


def thin_pass(recall_hits, recall_total, fp, hits: int = 18, total: int = 24, max_fp: int = 2) -> Column:
    """A pass resting exactly on its count boundary."""
    return ((F.col(recall_hits) == hits) & (F.col(recall_total) == total)) | (F.col(fp) == max_fp)


def select_cohort(candidates: DataFrame, want: str, needed: int, order: str = "ord") -> DataFrame:
    """Cases chosen in order until ``needed``, and skipped judgeable ones before that (backfill).

    Only the ``needed`` first acceptable rows are ranked; everything else is compared with
    the last of them.
    """
    judgeable = F.col("identity_truth") == want
    ok = judgeable & F.col("eligible") & ~F.col("contaminated")
    chosen = candidates.where(ok).orderBy(order).limit(needed)
    cut = chosen.agg(F.count(F.lit(1)).alias("_k"), F.max(order).alias("_last"))
    j = candidates.where(judgeable).join(F.broadcast(cut))
    full = F.col("_k") == needed
    return j.where(~full | (F.col(order) <= F.col("_last"))).select(
        "case_id", order, F.when(ok, "chosen").otherwise("backfilled").alias("role"),
        F.when(full, "complete").otherwise("inconclusive").alias("status"))
