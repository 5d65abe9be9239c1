from sorrel.operators import fitting


def test_leave_one_out_margins_end_in_a_small_plan(spark):
    rows = [(c, a, (c * 7 + a * 3) % 5 / 5, (c + a) % 4 / 4, a % 2 == 0, (c * 3 + a * 5) % 7 / 7) for c in range(12) for a in range(3)]
    df = spark.createDataFrame(rows, "case_id long, attempt long, text_relevance double, reference_relevance double, semantic_ok boolean, dino double")
    out = fitting.loo_selector(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Window" not in plan
    assert out.count() == 12
