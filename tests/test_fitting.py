"""Fits from counts against plain refits on small data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sorrel.operators import fitting

def truth():
    return F.col("truth_fail")


def naive_fit(rows):
    values = sorted({v for v, _ in rows})
    eps = max(1e-9, (values[-1] - values[0]) * 1e-6)
    grid = [values[0] - eps] + [(a + b) / 2 for a, b in zip(values, values[1:])] + [values[-1] + eps]
    fails, passes = sum(t for _, t in rows), sum(not t for _, t in rows)
    best = None
    for t in grid:
        tp = sum(1 for v, y in rows if y and v < t)
        fp = sum(1 for v, y in rows if not y and v < t)
        spec = (passes - fp) / passes if passes else 0.0
        key = (((tp / fails if fails else 0.0) + spec) / 2, spec, -t)
        best = key if best is None or key > best else best
    return -best[2], best[0], best[1]


@pytest.mark.parametrize("seed,n,step", [(1, 7, 0.1), (2, 15, 0.25), (3, 30, 0.01), (4, 25, 0.2), (5, 4, 0.5)])
def test_fit_and_leave_one_out(spark, seed, n, step):
    rng = random.Random(seed)
    rows = [(round(rng.randrange(0, int(1 / step) + 1) * step, 4), rng.random() < 0.5) for _ in range(n)]
    df = spark.createDataFrame(rows, "score double, truth_fail boolean")
    got = fitting.fit_threshold(df, "score", truth()).first()
    assert (got.threshold, got.balanced_accuracy, got.specificity) == pytest.approx(naive_fit(rows), abs=1e-12)
    folds = {(r.score, r.truth_fail): r for r in fitting.loo_thresholds(df, "score", truth()).collect()}
    for i, row in enumerate(rows):
        rest = rows[:i] + rows[i + 1:]
        t, _, _ = naive_fit(rest)
        assert folds[row].threshold == pytest.approx(t, abs=1e-12), (row, rows)
        assert folds[row].predicted_fail == (row[0] < t)
    assert sum(f.n for f in folds.values()) == n


def test_fit_ignores_row_order_and_bucketing(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(80)]
    df = spark.createDataFrame(rows, "score double, truth_fail boolean")
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), df.schema)
    assert fitting.fit_threshold(df, "score", truth()).first() == fitting.fit_threshold(shuffled, "score", truth()).first()


def test_candidate_thresholds(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.2,), (1.0,)], "x double")
    got = sorted(r.threshold for r in fitting.candidate_thresholds(df, "x").collect())
    assert got == pytest.approx([-0.8, 0.3, 0.7, 2.0])


def thresholds(values):
    u = sorted(set(values))
    return [u[0] - 1.0] + [(a + b) / 2 for a, b in zip(u, u[1:])] + [u[-1] + 1.0]


def naive_detector(rows):
    best = None
    for tt in thresholds([r[2] for r in rows]):
        for rt in thresholds([r[3] for r in rows]):
            pred = [not ok or (t < tt and r < rt) for _, ok, t, r in rows]
            tp = sum(1 for row, p in zip(rows, pred) if row[0] and p)
            fp = sum(1 for row, p in zip(rows, pred) if not row[0] and p)
            fails = sum(1 for row in rows if row[0])
            passes = len(rows) - fails
            fn, tn = fails - tp, passes - fp
            rec, fpr = (tp / fails if fails else 0.0), (fp / passes if passes else 0.0)
            den = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
            mcc = (tp * tn - fp * fn) / den if den else 0.0
            ok = rec >= fitting.MIN_RECALL and fpr <= fitting.MAX_FP_RATE
            key = (not ok, -mcc, fp, -rec, tp + fp, tt, rt)
            best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed,n,res", [(1, 8, 100), (2, 14, 6), (3, 12, 20)])
def test_detector_and_leave_one_out(spark, seed, n, res):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.5, rng.random() < 0.7, rng.randrange(res) / res, rng.randrange(res) / res) for _ in range(n)]
    df = spark.createDataFrame(rows, "truth_fail boolean, semantic_ok boolean, text_relevance double, reference_relevance double")
    want = naive_detector(rows)
    got = fitting.fit_detector(df).first()
    assert (got.feasible, got.false_positives, got.routed) == (not want[0], want[2], want[4])
    assert (got.mcc, got.text_threshold, got.reference_threshold) == pytest.approx((-want[1], want[5], want[6]), abs=1e-12)
    folds = {(r.truth_fail, r.semantic_ok, r.text_relevance, r.reference_relevance): r for r in fitting.loo_detector(df).collect()}
    for i, row in enumerate(rows):
        w = naive_detector(rows[:i] + rows[i + 1:])
        f = folds[row]
        assert (f.text_threshold, f.reference_threshold) == pytest.approx((w[5], w[6]), abs=1e-12), (row, rows)
        assert f.feasible == (not w[0])
        assert f.predicted_fail == (not row[1] or (row[2] < w[5] and row[3] < w[6]))


def make_cases(rng, n, budget=3):
    rows = []
    for c in range(n):
        for a in range(rng.randrange(1, budget + 1) + 1):
            rows.append((c, a, rng.randrange(12) / 10, rng.randrange(12) / 10, rng.random() < 0.6, rng.randrange(20) / 20))
    return rows


def naive_selector(rows, judged):
    cases = {}
    for c, a, t, r, ok, d in rows:
        cases.setdefault(c, {})[a] = (t, r, ok, d)
    def margins(col):
        out = {0.0}
        for m in cases.values():
            for a, v in m.items():
                g = v[col] - m[0][col]
                if a and g >= 0:
                    out.add(round(g, 12))
        return sorted(out)
    best = None
    for tm in margins(0):
        for rm in (margins(1) if not judged else [0.0]):
            deltas, pairs, exact = [], [], []
            for m in cases.values():
                def ok(a):
                    second = m[a][2] if judged else m[a][1] - m[0][1] + 1e-12 >= rm
                    return m[a][0] - m[0][0] + 1e-12 >= tm and second
                good = [(m[a][0], 0 if judged else m[a][1], -a) for a in m if a and ok(a)]
                sel = -max(good)[2] if good else 0
                deltas.append(m[sel][3] - m[0][3])
                pairs += [ok(a) == (m[a][3] > m[0][3]) for a in m if a]
                exact.append(sel == max(sorted(m), key=lambda a: m[a][3]))
            sign = sum(pairs) / len(pairs) if pairs else 0.0
            mean = round(sum(deltas) / len(deltas), 10)
            harm = sum(d < fitting.HARM_MARGIN for d in deltas)
            feas = sign >= fitting.MIN_SIGN_ACCURACY and harm <= fitting.MAX_HARMFUL and mean > 0
            key = (not feas, -mean, -sum(exact) / len(exact), -tm, -rm)
            if best is None or key < best[0]:
                best = (key, sign, harm, mean)
    return best


@pytest.mark.parametrize("seed,judged", [(1, False), (2, False), (3, True), (4, True)])
def test_selector_and_leave_one_out(spark, seed, judged):
    rng = random.Random(seed)
    rows = make_cases(rng, 6)
    df = spark.createDataFrame(rows, "case_id long, attempt long, text_relevance double, reference_relevance double, semantic_ok boolean, dino double")
    (key, sign, harm, mean) = naive_selector(rows, judged)
    got = fitting.fit_selector(df, judged).first()
    assert (got.feasible, got.harmful) == (not key[0], harm)
    assert (got.text_margin, got.sign_accuracy, got.mean_delta) == pytest.approx((-key[3], sign, mean), abs=1e-9)
    if not judged:
        assert got.reference_margin == pytest.approx(-key[4])
    folds = {r.case_id: r for r in fitting.loo_selector(df, judged).collect()}
    for c in {r[0] for r in rows}:
        k = naive_selector([r for r in rows if r[0] != c], judged)[0]
        assert (folds[c].feasible, folds[c].text_margin) == (not k[0], pytest.approx(-k[3])), c
        if not judged:
            assert folds[c].reference_margin == pytest.approx(-k[4])
