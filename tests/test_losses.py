"""Inputs that must give a named error or a defined result, never a quiet loss."""

import pytest
from pyspark.sql import functions as F

from sorrel.functions import text
from sorrel.operators import fitting, groups, sampling, scan, similarity, verdicts
from sorrel.sources import graphs, store


def test_ragged_and_non_finite_vectors_are_errors(spark):
    ragged = spark.createDataFrame([(1, "a", [1.0, 1.0]), (2, "a", [3.0, 3.0, 9.0])], "id long, k string, vec array<double>")
    with pytest.raises(ValueError, match="2 to 3 components"):
        groups.vector_mean(ragged, ["k"])
    with pytest.raises(Exception, match="does not have 2 components"):
        groups.vector_mean(ragged, ["k"], dim=2).collect()
    q = ragged.withColumnRenamed("id", "query_id")
    with pytest.raises(Exception, match="components"):
        similarity.top_k(q, ragged.withColumnRenamed("id", "doc_id"), 1).collect()
    nan = spark.createDataFrame([(i, [float("nan") if i > 2 else 1.0, float(i)]) for i in range(5)], "doc_id long, vec array<double>")
    with pytest.raises(Exception, match="no finite number"):
        similarity.top_k(nan.where("doc_id < 3").withColumnRenamed("doc_id", "query_id"), nan, 2).collect()


def test_near_ties_of_long_vectors(spark):
    base = [1e5 + 1e-7 * i for i in range(8)]
    rows = [(i, [x + (1e-9 if j == i % 8 else 0.0) * i for j, x in enumerate(base)]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    got = [r["doc_id"] for r in similarity.top_k(df.where("doc_id = 0").withColumnRenamed("doc_id", "query_id"), df, 5).orderBy("rank").collect()]

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    assert got == sorted(range(40), key=lambda i: (-dot(rows[0][1], rows[i][1]), i))[:5]


def test_splits_join_on_key_and_id(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), (None, 4), (None, 5)], "k string, id long")
    for seed in range(6):
        out = sampling.split_build_heldout(df, ["k"], "id", 5, seed).collect()
        assert len(out) == 6
        for k in ("a", "b", None):
            assert sorted(r["role"] for r in out if r["k"] == k) == ["build", "heldout"]
    out = sampling.last_k_heldout(df.withColumn("o", F.col("id")), ["k"], "id", "o").collect()
    assert len(out) == 6 and sum(r["role"] == "heldout" for r in out) == 3


def test_large_first_n(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    out = sampling.first_n(df, ["k"], ["id"], 1500)
    assert out.groupBy("k").agg(F.max("id"), F.count("*")).orderBy("k").collect() == [(0, 2998, 1500), (1, 2999, 1500)]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_scores_must_be_finite(spark, bad):
    rows = spark.createDataFrame([("a", 0, 0.1, 0.2, True), ("a", 1, bad, 0.9, True), ("a", 2, 0.8, 0.9, True)],
                                 "case_id string, attempt int, text_relevance double, reference_relevance double, semantic_ok boolean")
    with pytest.raises(Exception, match="text_relevance is not a finite number"):
        verdicts.select_repair(rows, 0.0, 0.0).collect()
    typed = rows.withColumn("truth_fail", F.col("attempt") == 1)
    with pytest.raises(Exception, match="not a finite number"):
        fitting.fit_threshold(typed, "text_relevance", F.col("truth_fail")).collect()
    with pytest.raises(Exception, match="not a finite number"):
        fitting.fit_detector(typed).collect()


@pytest.mark.parametrize("value,visible", [("not visible\n", False), ("\tNone ", False), (" n/a", False), ("red\n", True), (None, False)])
def test_white_space_of_any_kind(spark, value, visible):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.is_visible("v")).first()[0] is visible


def test_replies_and_phrases_with_odd_white_space(spark):
    yes = spark.createDataFrame([("\nYes",), (" yes, it is",), ("no\n",), (None,)], "r string")
    assert [r[0] for r in yes.select(text.says_yes("r")).collect()] == [True, True, False, False]
    docs = spark.createDataFrame([("out of the box",), ("out of  the",), ("of\nthe",), ("ofthe",)], "t string")
    assert [r[0] for r in docs.select(text.mentions(F.col("t"), F.lit("of the"))).collect()] == [True, True, True, False]
    assert docs.select(text.word_tokens("t")).first()[0] == ["out", "of", "the", "box"]
    replies = ['{"verdict": "pass\\n"}', '{"verdict": "PASS", "issues": [{"concept": " "}]}', '{"verdict": "FAIL", "issues": [{"concept": "a\\n"}, {"concept": ""}]}', '{"verdict": 1}']
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(text.judge_reply("r").alias("j")).select("j.*").collect()
    assert [tuple(g) for g in got] == [(True, False, []), (False, True, []), (False, False, ["a"]), (False, True, [])]


def test_gates_without_data(spark):
    one = spark.createDataFrame([(None, 1.0)], "a double, b double")
    gates = [("first", "a", ">=", 0.5), ("second", "b", "==", 1.0)]
    assert verdicts.readiness(verdicts.gate_table(one, gates)).first()[0] == "INCONCLUSIVE"
    strict = verdicts.gate_table(one, gates, null_fails=True)
    assert [(r["passed"], r["reason"]) for r in strict.collect()] == [(False, "no data"), (True, "ok")]
    assert verdicts.readiness(strict).first()[0] == "FAIL"


def test_dense_numbers_over_common_prefixes(spark):
    names = [f"Brand#{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "family string").repartition(6)
    out = {r["family"]: r["family_id"] for r in graphs.taxonomy_dimension(df).collect()}
    assert out == {**{n: i for i, n in enumerate(names)}, None: None}


def test_scan_cuts_large_keys_further(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 4000).cast("double").alias("v"))
    out = scan.ordered_scan(df, ["k"], "v", [], {"n": ("sum", F.lit(1), "upto")}, rows_per_bucket=20, max_buckets=8)
    assert out.where(F.col("n") != F.col("v") + 1).count() == 0 and out.count() == 4000
    sizes = scan.bucketed(df, ["k"], "v", rows_per_bucket=20, max_buckets=8).groupBy("_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 100


def test_vector_table_of_text_ids_and_store_without_vectors(spark, tmp_path):
    items = spark.createDataFrame([("ds:b", [3.0, 4.0]), ("ds:a", [0.0, 2.0])], "global_id string, vec array<double>")
    got = {r["global_id"]: (r["ref"], list(r["vec"])) for r in store.build_vectors(items, "global_id", "vec").collect()}
    assert got == {"ds:a": (0, [0.0, 1.0]), "ds:b": (1, [0.6, 0.8])}
    assert store.build_vectors(items.limit(0), "global_id", "vec").count() == 0
    with pytest.raises(ValueError, match="components"):
        store.build_vectors(items.unionByName(spark.createDataFrame([("ds:c", [1.0])], items.schema)), "global_id", "vec")
    species = spark.createDataFrame([("ds:a", "A a", "a", {"family": "f"})], "global_id string, scientific_name string, common_name string, taxonomy map<string,string>")
    things = spark.createDataFrame([("ds:a", 1, "p", "wing", 0, [1.0, 0.0])], "global_id string, ref long, path string, part string, ord int, vec array<double>")
    attrs = spark.createDataFrame([("ds:a", "colour", "red", 2, 3, "s")], "global_id string, slot string, value string, support int, visible_count int, source string")
    rel = spark.createDataFrame([("ds:a", "instance_of", "h")], "global_id string, type string, target string")
    tables = store.build_records(species, things, attrs, rel)
    del tables["vector"]
    store.write_store(tables, f"{tmp_path}/s", "none", 2)
    back = store.read_store(spark, f"{tmp_path}/s")
    assert "vector" not in back and store.lookup(back["posting"], back["record"], hub="h").count() == 1
    assert store.nearest_crops(back, things.select(F.col("ref").alias("query_id"), "vec"), 3).count() == 0


def test_sign_test_for_counts_of_any_size(spark):
    from math import comb, erfc, sqrt

    from sorrel.functions.scores import binomial_two_sided

    pairs = [(0, 0), (3, 9), (400, 380), (5000, 5200), (0, 900), (3_000_000_000, 3_000_100_000)]
    df = spark.createDataFrame(pairs, "b long, c long")
    got = [r[0] for r in df.select(binomial_two_sided("b", "c")).collect()]
    for (b, c), p in zip(pairs[:-1], got):
        n, lo = b + c, min(b, c)
        assert p == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(lo + 1)) / 2 ** n) if n else 1.0, rel=1e-9)
    z = (100_000 - 1) / sqrt(6_000_100_000)
    assert got[-1] == pytest.approx(erfc(z / sqrt(2)), rel=1e-3)
