"""Threshold and margin fitting with leave-one-out folds, from counts instead of refits.

A fold differs from the full data by one row. Its training counts are the global counts
minus that row's own contribution, which only depends on the side of the threshold the
row lies on. So every fold's best candidate is a running maximum over the candidates on
either side, and all folds come out of one scan. Rows with equal score and truth share
a fold. Candidate grids exclude midpoints that only the held-out row created.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.functions.scores import finite_score, mcc, ratio, wilson
from sorrel.operators.scan import ordered_scan
from sorrel.session import cut, widen

# fixed values
MIN_RECALL = 0.733
MAX_FP_RATE = 0.0834
MIN_SIGN_ACCURACY = 0.750
MAX_HARMFUL = 1
HARM_MARGIN = -0.02


def _distinct_axis(rows: DataFrame, keys: Sequence[str], value: str, tallies: dict[str, Column]) -> DataFrame:
    """Distinct values with running tallies, position, neighbours and range."""
    counted = rows.groupBy(*keys, finite_score(value).alias("v")).agg(
        F.count(F.lit(1)).alias("n_v"), *[c.alias(n) for n, c in tallies.items()])
    outputs = {"pos": ("sum", F.lit(1), "upto"), "prv": ("max", "v", "before"), "nxt": ("min", "v", "after"),
               "v_min": ("min", "v", "all"), "v_max": ("max", "v", "all")}
    for n in tallies:
        outputs[f"cum_{n}"] = ("sum", n, "upto")
        outputs[f"all_{n}"] = ("sum", n, "all")
    return ordered_scan(counted, keys, "v", [], outputs)


def candidate_thresholds(rows: DataFrame, value: str, pad: float | None = 1.0) -> DataFrame:
    """Midpoints of sorted distinct values plus one threshold beyond each end.

    ``pad`` is the distance beyond the ends; None means a millionth of the range.
    """
    axis = _distinct_axis(rows, [], value, {})
    eps = F.lit(pad) if pad is not None else F.greatest(F.lit(1e-9), (F.col("v_max") - F.col("v_min")) * 1e-6)
    above = F.coalesce((F.col("v") + F.col("nxt")) / 2, F.col("v") + eps)
    below = F.when(F.col("prv").isNull(), F.col("v") - eps)
    return axis.select(F.explode(F.filter(F.array(below, above), lambda x: x.isNotNull())).alias("threshold"))


def _balanced(tp, fp, fails, passes) -> tuple[Column, Column]:
    spec = ratio(passes - fp, passes)
    return (ratio(tp, fails) + spec) / 2, spec


def _curve(rows: DataFrame, keys: Sequence[str], score: str, truth: Column) -> DataFrame:
    return _distinct_axis(rows, keys, score, {"f": F.count_if(truth), "p": F.count_if(~truth)})


def fit_threshold(rows: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Best rule "score < threshold means FAIL" by balanced accuracy, specificity, lower threshold."""
    c = _curve(rows, keys, score, truth)
    eps = F.greatest(F.lit(1e-9), (F.col("v_max") - F.col("v_min")) * 1e-6)
    b, s = _balanced(F.col("cum_f"), F.col("cum_p"), F.col("all_f"), F.col("all_p"))
    b0, s0 = _balanced(F.lit(0), F.lit(0), F.col("all_f"), F.col("all_p"))
    above = F.struct(b.alias("b"), s.alias("s"), (-F.coalesce((F.col("v") + F.col("nxt")) / 2, F.col("v") + eps)).alias("t"))
    below = F.when(F.col("prv").isNull(), F.struct(b0.alias("b"), s0.alias("s"), (-(F.col("v") - eps)).alias("t")))
    best = c.groupBy(*keys).agg(F.max(F.greatest(above, below)).alias("_w"))
    return best.select(*keys, (-F.col("_w.t")).alias("threshold"), F.col("_w.b").alias("balanced_accuracy"), F.col("_w.s").alias("specificity"))


def loo_thresholds(rows: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Leave-one-out fits of ``fit_threshold``: one row per (keys, score, truth_fail).

    Columns: n (rows sharing the fold), threshold fitted without one such row, and
    predicted_fail for it.
    """
    keys = list(keys)
    c = _curve(rows, keys, score, truth)
    one = F.lit(1)
    before_f, before_p = F.col("cum_f") - F.col("f"), F.col("cum_p") - F.col("p")
    fails, passes = F.col("all_f"), F.col("all_p")

    def cand(tp, fp, nf, np_, index, t) -> Column:
        b, s = _balanced(tp, fp, nf, np_)
        return F.struct(b.alias("b"), s.alias("s"), (-index).cast("long").alias("i"), t.alias("t"))

    # label NULL marks a threshold beyond an end of the fold's range: index says which end
    low = F.when(F.col("prv").isNotNull(), (F.col("prv") + F.col("v")) / 2)
    high = F.when(F.col("nxt").isNotNull(), (F.col("v") + F.col("nxt")) / 2)
    under, at = F.col("pos") - 1, F.col("pos")
    marked = c.select(
        *keys, "v", "n_v", "f", "p", "prv", "nxt", "v_min", "v_max",
        cand(before_f, before_p, fails - one, passes, under, low).alias("low_f"),
        cand(F.col("cum_f") - one, F.col("cum_p"), fails - one, passes, at, high).alias("high_f"),
        cand(before_f, before_p, fails, passes - one, under, low).alias("low_p"),
        cand(F.col("cum_f"), F.col("cum_p") - one, fails, passes - one, at, high).alias("high_p"))
    scans = {}
    for cls in ("f", "p"):
        scans[f"lo_in_{cls}"] = ("max", f"low_{cls}", "upto")
        scans[f"lo_ex_{cls}"] = ("max", f"low_{cls}", "before")
        scans[f"hi_in_{cls}"] = ("max", f"high_{cls}", "from")
        scans[f"hi_ex_{cls}"] = ("max", f"high_{cls}", "after")
    s = ordered_scan(marked, keys, "v", [], scans)
    single = F.col("n_v") == 1
    merged_t = F.when(F.col("prv").isNotNull() & F.col("nxt").isNotNull(), (F.col("prv") + F.col("nxt")) / 2)
    folds = []
    for cls, flag in (("f", True), ("p", False)):
        merged = F.struct(F.col(f"low_{cls}.b").alias("b"), F.col(f"low_{cls}.s").alias("s"), F.col(f"low_{cls}.i").alias("i"), merged_t.alias("t"))
        best = F.when(single, F.greatest(F.col(f"lo_ex_{cls}"), merged, F.col(f"hi_ex_{cls}"))).otherwise(
            F.greatest(F.col(f"lo_in_{cls}"), F.col(f"hi_in_{cls}")))
        folds.append(F.struct(F.lit(flag).alias("truth_fail"), F.col(cls).alias("n"), best.alias("best")))
    out = s.withColumn("_fold", F.explode(F.array(*folds))).where(F.col("_fold.n") > 0)
    lo_end = F.when(single & F.col("prv").isNull(), F.col("nxt")).otherwise(F.col("v_min"))
    hi_end = F.when(single & F.col("nxt").isNull(), F.col("prv")).otherwise(F.col("v_max"))
    eps = F.greatest(F.lit(1e-9), (hi_end - lo_end) * 1e-6)
    is_low_end = F.col("_fold.best.i") == 0
    threshold = F.coalesce(F.col("_fold.best.t"), F.when(is_low_end, lo_end - eps).otherwise(hi_end + eps))
    return out.select(*keys, F.col("v").alias(score), "_fold.truth_fail", "_fold.n", threshold.alias("threshold")).withColumn(
        "predicted_fail", F.col(score) < F.col("threshold"))


def signal_report(rows: DataFrame, signals: Sequence[str], truth: Column) -> DataFrame:
    """Per signal, the rule "score < threshold means FAIL" on its own rows and left one out.

    (signal, sample, tp, fp, tn, fn, recall, specificity) with Wilson bounds; ``sample`` is
    in_sample or leave_one_out, ``threshold`` the one fitted on all rows.
    """
    long = rows.select(truth.alias("_truth"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("score")) for s in signals])).alias("_s")).select("_truth", "_s.*")
    t = F.col("_truth")
    fit = fit_threshold(long, "score", t, ["signal"]).select("signal", "threshold")
    own = long.join(fit, "signal").select("signal", F.lit("in_sample").alias("sample"), t.alias("t"), (F.col("score") < F.col("threshold")).alias("p"), F.lit(1).cast("long").alias("n"))
    out = loo_thresholds(long, "score", t, ["signal"]).select("signal", F.lit("leave_one_out").alias("sample"), F.col("truth_fail").alias("t"), F.col("predicted_fail").alias("p"), "n")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, p = F.col("t"), F.col("p")
    c = own.unionByName(out).groupBy("signal", "sample").agg(part(t & p).alias("tp"), part(~t & p).alias("fp"), part(~t & ~p).alias("tn"), part(t & ~p).alias("fn"))
    (rl, rh), (sl, sh) = wilson("tp", F.col("tp") + F.col("fn")), wilson("tn", F.col("tn") + F.col("fp"))
    return c.join(fit, "signal").select(
        "signal", "sample", "threshold", "tp", "fp", "tn", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), rl.alias("recall_low"), rh.alias("recall_high"), sl.alias("specificity_low"), sh.alias("specificity_high"))


# --- two thresholds ----------------------------------------------------------------

def _axis_with_floor(axis: DataFrame, index: str, label: str, pad: float = 1.0) -> DataFrame:
    """(index, threshold) from 0, the threshold below every value, to the one above all."""
    above = F.struct(F.col("pos").alias(index), F.coalesce((F.col("v") + F.col("nxt")) / 2, F.col("v") + pad).alias(label))
    below = F.when(F.col("prv").isNull(), F.struct((F.col("pos") - 1).alias(index), (F.col("v") - pad).alias(label)))
    return axis.select(F.explode(F.filter(F.array(below, above), lambda x: x.isNotNull())).alias("_x")).select("_x.*")


def detector_grid(rows: DataFrame, text: str = "text_relevance", reference: str = "reference_relevance") -> dict[str, DataFrame]:
    """Counts of routed rows at every pair of thresholds, by two cumulative sums.

    Rows are grouped to distinct score pairs first, so the grid is as large as the score
    resolution, whatever the number of rows.
    """
    t_axis, r_axis = cut(_distinct_axis(rows, [], text, {})), cut(_distinct_axis(rows, [], reference, {}))
    n_r = r_axis.agg(F.max("pos")).first()[0] or 0
    typed = (rows.select("semantic_ok", "truth_fail", finite_score(text).alias("_t"), finite_score(reference).alias("_r"))
             .groupBy("semantic_ok", "truth_fail", "_t", "_r").agg(F.count(F.lit(1)).alias("n")))
    typed = typed.join(t_axis.select(F.col("v").alias("_t"), F.col("pos").alias("a"), F.col("n_v").alias("n_t"), F.col("prv").alias("t_prv"), F.col("nxt").alias("t_nxt")), "_t")
    typed = cut(typed.join(r_axis.select(F.col("v").alias("_r"), F.col("pos").alias("b"), F.col("n_v").alias("n_r"), F.col("prv").alias("r_prv"), F.col("nxt").alias("r_nxt")), "_r"))
    t, r, w, ok = F.col("truth_fail"), ~F.col("truth_fail"), F.col("n"), F.col("semantic_ok")
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    totals = typed.agg(part(t).alias("fails"), part(r).alias("passes"), part(t & ~ok).alias("s_f"), part(r & ~ok).alias("s_p"))
    cells = typed.where(ok).groupBy("a", "b").agg(part(t).alias("f"), part(r).alias("p"))
    labels_t, labels_r = _axis_with_floor(t_axis, "a", "text_threshold"), _axis_with_floor(r_axis, "b", "reference_threshold")
    dense = labels_t.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_r).cast("long"))))
    dense = dense.join(cells, ["a", "b"], "left").fillna(0, ["f", "p"])
    along_b = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    along_a = Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    for axis in (along_b, along_a):
        dense = dense.withColumn("f", F.sum("f").over(axis)).withColumn("p", F.sum("p").over(axis))
    grid = dense.join(F.broadcast(totals)).select(
        "a", "b", "text_threshold", (F.col("s_f") + F.col("f")).alias("tp"), (F.col("s_p") + F.col("p")).alias("fp"), "fails", "passes")
    return {"grid": grid.join(labels_r, "b"), "typed": typed, "labels_t": labels_t, "labels_r": labels_r}


def _objective(tp, fp, fails, passes) -> Column:
    recall, fpr = ratio(tp, fails), ratio(fp, passes)
    return F.struct(
        ((recall >= MIN_RECALL) & (fpr <= MAX_FP_RATE)).alias("feasible"), mcc(tp, fp, passes - fp, fails - tp).alias("mcc"),
        (-fp).alias("neg_fp"), recall.alias("recall"), (-(tp + fp)).alias("neg_routed"), (-F.col("a")).alias("neg_a"), (-F.col("b")).alias("neg_b"))


def fit_detector(rows: DataFrame, **columns) -> DataFrame:
    """Best guarded conjunction: feasible first, then MCC, fewer false positives, recall, fewer routed, lower thresholds."""
    g = detector_grid(rows, **columns)["grid"]
    best = g.agg(F.max(F.struct(_objective(F.col("tp"), F.col("fp"), F.col("fails"), F.col("passes")).alias("o"),
                                F.struct("text_threshold", "reference_threshold", "fp", "passes").alias("x"))).alias("_w"))
    return best.select(
        F.col("_w.x.text_threshold").alias("text_threshold"), F.col("_w.x.reference_threshold").alias("reference_threshold"),
        F.col("_w.o.feasible").alias("feasible"), F.col("_w.o.recall").alias("recall"), F.col("_w.x.fp").alias("false_positives"),
        ratio(F.col("_w.x.fp"), F.col("_w.x.passes")).alias("false_positive_rate"), F.col("_w.o.mcc").alias("mcc"),
        (-F.col("_w.o.neg_routed")).alias("routed"))


def loo_detector(rows: DataFrame, text: str = "text_relevance", reference: str = "reference_relevance") -> DataFrame:
    """Leave-one-out fits of ``fit_detector`` for every distinct (judge, truth, text, reference) row type.

    Grid points that route the held-out row form one quadrant; running maxima in both
    directions give the best point inside and outside it for all row types at once.
    """
    parts = detector_grid(rows, text, reference)
    tp, fp, nf, np_ = F.col("tp"), F.col("fp"), F.col("fails"), F.col("passes")
    sides = F.array(
        F.struct(F.lit(True).alias("truth_fail"), _objective(tp, fp, nf - 1, np_).alias("un"), _objective(tp - 1, fp, nf - 1, np_).alias("co")),
        F.struct(F.lit(False).alias("truth_fail"), _objective(tp, fp, nf, np_ - 1).alias("un"), _objective(tp, fp - 1, nf, np_ - 1).alias("co")))
    g = cut(parts["grid"].select("a", "b", F.explode(sides).alias("_s")).select("a", "b", "_s.*"))
    row = Window.partitionBy("truth_fail", "a").orderBy("b")
    column = Window.partitionBy("truth_fail", "b").orderBy("a").rowsBetween(0, Window.unboundedFollowing)
    quad = g.select("a", "b", "truth_fail", F.max("un").over(row.rowsBetween(Window.unboundedPreceding, -1)).alias("left_un"),
                    F.max("co").over(row.rowsBetween(0, Window.unboundedFollowing)).alias("right_co"))
    quad = quad.select("a", "b", "truth_fail", F.max("left_un").over(column).alias("left_un"), F.max("right_co").over(column).alias("right_co"))
    per_a = g.groupBy("truth_fail", "a").agg(F.max("un").alias("un"))
    below = per_a.select("truth_fail", "a", F.max("un").over(
        Window.partitionBy("truth_fail").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)).alias("below_un"))
    anywhere = g.groupBy("truth_fail").agg(F.max("co").alias("any_co"))
    f = (parts["typed"].join(quad, ["a", "b", "truth_fail"], "left").join(below, ["a", "truth_fail"], "left").join(F.broadcast(anywhere), "truth_fail"))
    f = f.withColumn("_w", F.when(F.col("semantic_ok"), F.greatest("below_un", "left_un", "right_co")).otherwise(F.col("any_co")))
    f = f.withColumn("_wa", -F.col("_w.neg_a")).withColumn("_wb", -F.col("_w.neg_b"))
    f = f.join(parts["labels_t"].withColumnRenamed("a", "_wa"), "_wa").join(parts["labels_r"].withColumnRenamed("b", "_wb"), "_wb")

    def merged(prv, nxt) -> Column:
        return F.when(F.col(prv).isNull(), F.col(nxt) - 1.0).when(F.col(nxt).isNull(), F.col(prv) + 1.0).otherwise((F.col(prv) + F.col(nxt)) / 2)

    tt = F.when((F.col("n_t") == 1) & (F.col("_wa") == F.col("a") - 1), merged("t_prv", "t_nxt")).otherwise(F.col("text_threshold"))
    rt = F.when((F.col("n_r") == 1) & (F.col("_wb") == F.col("b") - 1), merged("r_prv", "r_nxt")).otherwise(F.col("reference_threshold"))
    out = f.select("semantic_ok", "truth_fail", F.col("_t").alias(text), F.col("_r").alias(reference), "n",
                   F.col("_w.feasible").alias("feasible"), tt.alias("text_threshold"), rt.alias("reference_threshold"))
    return out.withColumn("predicted_fail", ~F.col("semantic_ok") | (
        (F.col(text) < F.col("text_threshold")) & (F.col(reference) < F.col("reference_threshold"))))


# --- margins -------------------------------------------------------------------------

_EXACT = "decimal(24,12)"


def gain_margins(rows: DataFrame, signal: str, case: str = "case_id") -> DataFrame:
    """Non-negative gains over the draft rounded to 12 places, with zero: candidate margins."""
    draft = rows.where(F.col("attempt") == 0).select(case, F.col(signal).alias("_d"))
    gains = rows.where(F.col("attempt") > 0).join(draft, case).select(F.bround(F.col(signal) - F.col("_d"), 12).alias("margin"))
    zero = rows.sparkSession.range(1).select(F.lit(0.0).alias("margin"))
    return gains.where(F.col("margin") >= 0).unionByName(zero).distinct()


def _selector_base(rows: DataFrame, judged: bool, case: str) -> DataFrame:
    """Attempts with gains, answer delta, the case's oracle, and what beats them."""
    rows = rows.withColumns({c: finite_score(c) for c in ("text_relevance", "reference_relevance")})
    d = rows.where(F.col("attempt") == 0).select(case, F.col("text_relevance").alias("_dt"), F.col("reference_relevance").alias("_dr"), F.col("dino").alias("_dd"))
    oracle = rows.groupBy(case).agg(F.min_by("attempt", F.struct(-F.col("dino"), F.col("attempt"))).alias("oracle"))
    a = rows.where(F.col("attempt") > 0).join(d, case).join(oracle, case)
    g = F.bround(F.col("text_relevance") - F.col("_dt"), 12)
    h = F.when(F.coalesce("semantic_ok", F.lit(False)), F.lit(0.0)).otherwise(F.lit(-1.0)) if judged else F.bround(F.col("reference_relevance") - F.col("_dr"), 12)
    order = [F.col("text_relevance").desc()] + ([] if judged else [F.col("reference_relevance").desc()]) + [F.col("attempt")]
    # attempts of a case are few: the retry budget bounds them
    earlier = Window.partitionBy(case).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("g", g).withColumn("h", h)
    return a.select(case, "attempt", "oracle", "g", "h", (F.col("dino") > F.col("_dd")).alias("better"),
                    (F.col("dino") - F.col("_dd")).alias("delta"), F.max("h").over(earlier).alias("beaten"))


def _points(base: DataFrame, case: str) -> DataFrame:
    """Corner points whose suffix sums give each metric at every margin pair.

    An attempt is selected on a rectangle of margins: up to its text gain, and between the
    reference gains of the attempts preferred to it and its own.
    """
    live = base.where((F.col("g") >= 0) & (F.col("h") >= 0))
    lo = F.coalesce(F.col("beaten"), F.lit(-1.0))
    delta = F.col("delta").cast(_EXACT)
    harm = (F.col("delta") < HARM_MARGIN).cast("long")
    exact = F.when(F.col("oracle") == F.col("attempt"), 1).when(F.col("oracle") == 0, -1).otherwise(0).cast("long")
    pair = F.when(F.col("better"), 1).otherwise(-1).cast("long")
    zero = F.lit(0).cast("long")

    def point(y, d, hm, ex, pr):
        return F.struct(F.col("g").alias("x"), y.alias("y"), d.cast(_EXACT).alias("delta"), hm.alias("harm"), ex.alias("exact"), pr.alias("pair"))

    wins = F.col("h") > lo
    corners = F.filter(F.array(
        point(F.col("h"), F.lit(0), zero, zero, pair),
        F.when(wins, point(F.col("h"), delta, harm, exact, zero)),
        F.when(wins & (lo >= 0), point(lo, -delta, -harm, -exact, zero))), lambda c: c.isNotNull())
    return live.select(case, F.explode(corners).alias("_c")).select(case, "_c.*")


_SUMS = ("delta", "harm", "exact", "pair")


def _margin_axes(base: DataFrame, judged: bool) -> tuple[DataFrame, DataFrame]:
    spark = base.sparkSession
    zero = spark.range(1).select(F.lit(0.0).alias("m"))

    def axis(column):
        vals = base.where(F.col(column) >= 0).select(F.col(column).alias("m")).unionByName(zero).distinct()
        return cut(ordered_scan(vals, [], "m", [], {"i": ("sum", F.lit(1), "upto")}))

    return axis("g"), (zero.withColumn("i", F.lit(1).cast("long")) if judged else axis("h"))


def _surface(points: DataFrame, gx: DataFrame, gy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dense suffix sums of corner points over the margin grid, per ``keys``."""
    keys = list(keys)
    n_y = gy.agg(F.max("i")).first()[0]
    at = (points.join(gx.select(F.col("m").alias("x"), F.col("i").alias("a")), "x").join(gy.select(F.col("m").alias("y"), F.col("i").alias("b")), "y")
          .groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    heads = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select(F.lit(1).alias("_one"))
    n_x = gx.agg(F.max("i")).first()[0]
    dense = heads.withColumn("a", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_x).cast("long")))).withColumn(
        "b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_y).cast("long"))))
    dense = dense.join(at, keys + ["a", "b"], "left").fillna(0, ["harm", "exact", "pair"]).withColumn("delta", F.coalesce("delta", F.lit(0).cast(_EXACT)))
    for part, order in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
        dense = dense.select(*keys, "a", "b", *[F.sum(c).over(w).alias(c) for c in _SUMS])
    return dense


def _selector_objective(n_cases, n_pairs, base_pair, base_exact) -> tuple[Column, dict[str, Column]]:
    sign = ratio(base_pair + F.col("pair"), n_pairs)
    mean = ratio(F.col("delta").cast("double"), n_cases)
    exact = ratio(base_exact + F.col("exact"), n_cases)
    feasible = (sign >= MIN_SIGN_ACCURACY) & (F.col("harm") <= MAX_HARMFUL) & (mean > 0)
    return F.struct(feasible.alias("feasible"), mean.alias("mean"), exact.alias("exact"), F.col("a").alias("a"), F.col("b").alias("b")), {
        "sign_accuracy": sign, "harmful": F.col("harm"), "mean_delta": mean, "exact_best_rate": exact, "feasible": feasible}


def _selector_totals(rows: DataFrame, base: DataFrame, keys: Sequence[str], case: str) -> DataFrame:
    cases = rows.groupBy(case).agg(F.min_by("attempt", F.struct(-F.col("dino"), F.col("attempt"))).alias("oracle"))
    c = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("oracle") == 0).alias("base_exact"))
    p = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("better")).alias("base_pair"))
    return c.join(p, list(keys), "left").fillna(0, ["n_pairs", "base_pair"]) if keys else c.join(F.broadcast(p))


def fit_selector(rows: DataFrame, judged: bool = False, case: str = "case_id") -> DataFrame:
    """Best margins by mean delta, exact-best rate and larger margins, feasible ones first.

    ``rows`` are candidates (case, attempt, text_relevance, reference_relevance,
    semantic_ok, dino), attempt 0 the draft. ``judged`` replaces the reference margin by
    the judge's verdict.
    """
    base = cut(_selector_base(rows, judged, case))
    gx, gy = _margin_axes(base, judged)
    surface = _surface(_points(base, case), gx, gy, [])
    s = surface.join(F.broadcast(_selector_totals(rows, base, [], case)))
    key, m = _selector_objective(F.col("n_cases"), F.col("n_pairs"), F.col("base_pair"), F.col("base_exact"))
    best = s.agg(F.max(F.struct(key.alias("o"), F.struct(*[c.alias(n) for n, c in m.items()]).alias("x"))).alias("_w"))
    return (best.select("_w.x.*", F.col("_w.o.a").alias("a"), F.col("_w.o.b").alias("b"))
            .join(gx.select(F.col("m").alias("text_margin"), F.col("i").alias("a")), "a")
            .join(gy.select(F.col("m").alias("reference_margin"), F.col("i").alias("b")), "b").drop("a", "b"))


def loo_selector(rows: DataFrame, judged: bool = False, case: str = "case_id") -> DataFrame:
    """Leave-one-case-out margins: (case, text_margin, reference_margin, feasible).

    Work is cases times margin grid, so quantise scores before studying many cases.
    Margins that only the held-out case contributed are left out of its fold.
    """
    # every step is written down: one plan of them all, with each small table joined where it is used, fills the driver
    base = cut(_selector_base(rows, judged, case))
    gx, gy = _margin_axes(base, judged)
    points = cut(_points(base, case))
    total = cut(_surface(points, gx, gy, []))
    mine = cut(_selector_totals(rows, base, [case], case))
    totals = ("n_cases", "n_pairs", "base_pair", "base_exact")
    t = cut(mine.agg(*[F.sum(c).alias(f"all_{c}") for c in totals]))
    sparse = points.join(gx.select(F.col("m").alias("x"), F.col("i").alias("pa")), "x").join(gy.select(F.col("m").alias("y"), F.col("i").alias("pb")), "y")
    own = cut(sparse.withColumn("a", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pa"))))
              .withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pb"))))
              .groupBy(case, "a", "b").agg(*[F.sum(c).alias(f"own_{c}") for c in _SUMS]))

    def sole(axis, column, name):
        owners = base.where(F.col(column) >= 0).groupBy(F.col(column).alias("m")).agg(F.countDistinct(case).alias("_k"), F.first(case).alias("_o"))
        return axis.join(owners, "m", "left").select(F.col("i").alias(name), F.when((F.col("_k") == 1) & (F.col("m") > 0), F.col("_o")).alias(f"sole_{name}"))

    grid = total.join(sole(gx, "g", "a"), "a")
    if not judged:
        grid = grid.join(sole(gy, "h", "b"), "b")
    grid = cut(grid.join(F.broadcast(t)))
    folds = widen(mine.where(F.col(case).isNotNull())).crossJoin(grid)
    for name in ("a",) if judged else ("a", "b"):
        folds = folds.where(F.coalesce(F.col(f"sole_{name}") != F.col(case), F.lit(True)))
    folds = folds.join(own, [case, "a", "b"], "left")
    for c in _SUMS:
        folds = folds.withColumn(c, F.col(c) - F.coalesce(F.col(f"own_{c}"), F.lit(0)))
    rest = lambda c: F.col(f"all_{c}") - F.col(c)
    key, _ = _selector_objective(*map(rest, totals))
    best = cut(folds.groupBy(case).agg(F.max(key).alias("_w")).select(case, "_w.feasible", "_w.a", "_w.b"))
    return (best.join(gx.select(F.col("m").alias("text_margin"), F.col("i").alias("a")), "a")
            .join(gy.select(F.col("m").alias("reference_margin"), F.col("i").alias("b")), "b").drop("a", "b"))


def apply_margins(rows: DataFrame, margins: DataFrame, judged: bool = False, case: str = "case_id") -> DataFrame:
    """Selection per case under its own fold's margins, with answer delta, exactness and pair agreement."""
    base = _selector_base(rows, judged, case).join(margins.select(case, "text_margin", "reference_margin"), case)
    ok = (F.col("g") >= F.col("text_margin")) & (F.col("h") >= F.col("reference_margin"))
    free = ok & ~F.coalesce((F.col("beaten") >= F.col("reference_margin")), F.lit(False))
    # an earlier attempt has at least this text gain, so it is eligible when its reference gain is
    per = base.groupBy(case).agg(
        F.max(F.when(free, F.struct("attempt", "delta"))).alias("_s"), F.first("oracle").alias("oracle"),
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(ok == F.col("better")).alias("right_pairs"))
    every_case = rows.select(case).distinct()
    return every_case.join(per, case, "left").select(
        case, F.coalesce("_s.attempt", F.lit(0)).cast("long").alias("selected"), F.coalesce("_s.delta", F.lit(0.0)).alias("dino_delta"),
        (F.coalesce("_s.attempt", F.lit(0)) == F.coalesce("oracle", F.lit(0))).alias("exact"),
        F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("right_pairs", F.lit(0)).alias("right_pairs"))
