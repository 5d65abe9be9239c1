"""Tasks of the consensus operators hold a bounded number of rows, with the results of the joins they replace."""

from collections import Counter

from pyspark.sql import functions as F

from sorrel.operators import consensus


def test_arms_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(consensus, "ROWS_PER_TASK", 50)
    rows = spark.range(600).select((F.col("id") % 7).alias("concept"), (F.col("id") % 91).alias("path"), (F.col("id") * 37 % 101).cast("double").alias("score"), (F.col("id") % 3).alias("part_type"))
    odd = spark.createDataFrame([(None, 1, 5.0, 0), (1, None, 6.0, 0), (None, None, None, 1), (1, 3, None, 1)], "concept long, path long, score double, part_type long")
    flat, graph = rows.where("score > 40").unionByName(odd).drop("part_type"), rows.where("score < 70").unionByName(odd)
    both = consensus.both_arms(flat, graph)
    assert both.rdd.getNumPartitions() > 10
    f = flat.groupBy("concept", "path").agg(F.max("score").alias("_fs"))
    g = graph.groupBy("concept", "path").agg(F.max("score").alias("_gs"))
    joined = f.join(g, ["concept", "path"], "full_outer")
    assert Counter(map(tuple, both.collect())) == Counter(map(tuple, joined.select("concept", "path", "_fs", "_gs").collect()))


def test_heldout_labels_sort_no_reads_for_the_build_set(spark, monkeypatch):
    monkeypatch.setattr(consensus, "ROWS_PER_TASK", 50)
    reads = spark.range(900).select((F.col("id") % 11).alias("concept"), F.when(F.col("id") % 50 > 0, F.col("id") % 300).alias("path"), F.concat(F.lit("V"), F.col("id") * 7 % 5).alias("value"))
    build = spark.range(0, 300, 3).select(F.when(F.col("id") > 0, F.col("id")).alias("path"))
    out = consensus.heldout_labels(reads, build, ["concept"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
    taken, least = {r.path for r in build.collect()}, {}
    for c, p, v in reads.collect():
        if p is None or p not in taken:
            least[c, p] = min(v, least.get((c, p), v))
    votes = Counter((c, v.lower()) for (c, _), v in least.items())
    want = set()
    for c in {c for c, _ in votes}:
        ranked = sorted(((n, v) for (d, v), n in votes.items() if d == c), reverse=True)
        if len(ranked) == 1 or ranked[0][0] > ranked[1][0]:
            want.add((c, ranked[0][1], ranked[0][0]))
    assert {tuple(r) for r in out.collect()} == want and len(want) > 0
