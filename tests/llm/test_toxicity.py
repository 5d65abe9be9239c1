import numpy as np

from sorrel.llm import toxicity
from sorrel.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    row, col = np.repeat(np.arange(40), 3), rng.integers(0, 12, 120)
    grade, w, theta = rng.integers(0, 4, 40), rng.normal(size=12), np.array([-1.0, 0.2, 1.5])
    _, gw, gt = toxicity.loss_and_gradients(row, col, grade, w, theta)
    for g, p, k in [(gw, w, 0), (gw, w, 7), (gt, theta, 0), (gt, theta, 2)]:
        p[k] += 1e-6
        up = toxicity.loss_and_gradients(row, col, grade, w, theta)[0]
        p[k] -= 2e-6
        down = toxicity.loss_and_gradients(row, col, grade, w, theta)[0]
        p[k] += 1e-6
        assert abs(g[k] - (up - down) / 2e-6) < 1e-6


def test_severity_rises_with_ordered_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 600)
    rows = [[int(rng.integers(3, 30))] + [0] * int(g >= 1) + [1] * int(g >= 2) for g in grade]
    row, col = np.repeat(np.arange(600), [len(r) for r in rows]), np.concatenate(rows)
    w, theta = toxicity.fit(row, col, grade, 30, 3)
    model = toxicity.OrdinalModel({}, theta)
    expected = [model.above(w[r].sum()).sum() for r in rows]
    assert [np.mean([e for e, g in zip(expected, grade) if g == k]) for k in range(3)] == sorted(
        np.mean([e for e, g in zip(expected, grade) if g == k]) for k in range(3))
    assert np.mean(np.round(expected) == grade) > 0.95 and (np.diff(theta) > 0).all()
    assert w[0] > 1 and w[1] > 1 and w[3:].std() < 0.6


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels.where("doc_id % 3 <> 0"))
    out = toxicity.severity(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    caught, wrong = out[out.truth == 1].toxic.mean(), out[out.truth == 0].toxic.mean()
    assert caught > 0.87 and wrong < 0.015, (caught, wrong)
    assert (out.expected_severity.between(0, 2)).all()
    plain = {r["doc_id"]: r["text"] for r in docs.limit(40).collect()}
    for i, s in zip(out.doc_id, out.expected_severity):
        if i in plain:
            eta = sum(model.weights.get(f, 0) for f in toxicity.features(plain[i]))
            assert abs(s - sum(1 / (1 + np.exp(t - eta)) for t in model.thresholds)) < 1e-9


def test_odd_rows(spark):
    rows = [(i, "fine day here " + "abc"[i % 3], "x", 1.0) for i in range(30)] + [(100 + i, "awful zzzzz " + "abc"[i % 3], None, 2.0) for i in range(30)]
    rows += [(None, "awful zzzzz", "n", 0.0), (200, None, "n", 0.0), (201, "", None, 0.0), (100, "awful zzzzz a", "again", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, grade double")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(30)] + [(100 + i, 1, 1 + i % 2) for i in range(30)] + [(None, 1, 1), (200, None, None)],
                                   "doc_id long, toxic int, level int")
    model = toxicity.learn(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == list(range(30)) + [200, 201]
    assert toxicity.severity(docs, model).count() == len(rows)
    assert toxicity.learn(docs, labels, grade_col="level").thresholds.shape == (2,)
    nothing = toxicity.learn(docs.limit(0), labels)
    assert toxicity.drop_toxic(docs, nothing).count() == len(rows) and toxicity.severity(docs.limit(0), model).count() == 0


def test_query_keeps_every_document(spark):
    out = QUERIES["op2_ordinal_toxicity"](spark, "/root/testdata/sf0.01")
    assert out.count() == 1000 and out.select("doc_id").distinct().count() == 1000
