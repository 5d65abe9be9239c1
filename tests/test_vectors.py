"""Blocked search, ranks, components and group vectors against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.functions.vectors import reference_weights, unit
from sorrel.operators import groups, sampling, selection
from sorrel.operators.similarity import threshold_forest, top_k


def pool(spark, n, dim=6, concepts=5, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    if copies:
        m[:copies] = m[0]
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, int(i % concepts), int(i % concepts % 2), int(i % 3), [float(x) for x in m[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, concept long, family long, part long, vec array<double>").repartition(3)


def seq_dot(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def naive(rows, q, k, ok, cap=None):
    scored = sorted([(-seq_dot(q[4], r[4]), r[0], r[1]) for r in rows if ok(q, r)])
    out, per = [], {}
    for s, i, c in scored:
        if cap is None or per.get(c, 0) < cap:
            out.append(i)
            per[c] = per.get(c, 0) + 1
        if len(out) == k:
            break
    return out


@pytest.mark.parametrize("block_rows,copies", [(4096, 0), (9, 0), (9, 20)])
def test_search_in_blocks(spark, block_rows, copies):
    rows, df = pool(spark, 60, copies=copies)
    q, d = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")
    for cap in (None, 2):
        hits = top_k(q, d, 5, tag="concept", group="part", cap=cap, block_rows=block_rows).collect()
        got = {}
        for h in sorted(hits, key=lambda h: h.rank):
            got.setdefault(h.query_id, []).append(h.doc_id)
        for r in rows:
            assert got[r[0]] == naive(rows, r, 5, lambda a, b: a[1] != b[1] and a[3] == b[3], cap), (r[0], cap)


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_sibling_rank(spark, block_rows):
    rows, df = pool(spark, 50, seed=4)
    got = {r.query_id: (r.sib_rank, r.n_siblings) for r in selection.sibling_rank(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")).collect()}
    for q in rows:
        ranked = naive(rows, q, 999, lambda a, b: a[1] != b[1] and a[3] == b[3])
        sib = [i + 1 for i, d in enumerate(ranked) if rows[d][2] == q[2]]
        assert got[q[0]] == (min(sib), len(sib))


@pytest.mark.parametrize("block_rows,copies", [(2048, 0), (7, 0), (7, 25)])
def test_hubs_are_components(spark, block_rows, copies):
    rows, df = pool(spark, 60, dim=3, seed=2, copies=copies)
    tau = 0.93
    forest = threshold_forest(df, tau, group="part", block_rows=block_rows)
    got = {r.node: r.root for r in groups.components(forest).collect()}
    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[3] == b[3] and seq_dot(a[4], b[4]) >= tau:
                    low = min(root[a[0]], root[b[0]])
                    if root[a[0]] != low or root[b[0]] != low:
                        root[a[0]] = root[b[0]] = low
                        changed = True
    for i, r in root.items():
        assert got.get(i, i) == r
    # a cluster of copies yields edges linear in its size per block pair
    assert forest.count() <= 2 * 60 * (60 // block_rows + 1)


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in groups.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_small_components_are_noise(spark):
    rows = [(1, "p", [1.0, 0.0]), (2, "p", [1.0, 0.0]), (3, "p", [0.0, 1.0]), (4, "q", [1.0, 0.0]), (5, "p", [0.99999, 0.0])]
    df = spark.createDataFrame(rows, "id long, part string, vec array<double>")
    got = {r.id: r.hub_id for r in groups.threshold_hubs(df, 0.9).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 3: -1, 4: -1}


def test_centroid_and_medoid_forms(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 300))
    rows = [("g" if i < 9 else "h", i, [float(x) for x in m[i]]) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    wide = {r.g: r["mean"] for r in groups.vector_mean(df, ["g"]).collect()}
    assert np.allclose(wide["g"], m[:9].mean(axis=0)) and np.allclose(wide["h"], m[9:].mean(axis=0))
    med = {r.g: r.id for r in groups.medoids(df, ["g"], "id", full_cosine=True).collect()}
    mean = m[:9].mean(axis=0)
    assert med["g"] == int(np.argmax(m[:9] @ mean / np.linalg.norm(m[:9], axis=1)))


def test_medoid_tie_goes_to_the_lower_id(spark):
    df = spark.createDataFrame([("g", 7, [1.0, 0.0]), ("g", 3, [1.0, 0.0])], "g string, id long, vec array<double>")
    assert groups.medoids(df, ["g"], "id").first().id == 3


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.u for r in df.select(unit("v").alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    with pytest.raises(Exception, match="non-zero norm"):
        df.select(unit("v", strict=True).alias("u")).collect()


def test_reference_weight_boundaries(spark):
    df = spark.createDataFrame([(1, 4), (1, 20), (0, 3), (2, 0), (0, 0)], "o int, b int")
    w = [r.w for r in df.select(reference_weights("o", "b").alias("w")).collect()]
    assert w[0][0] == pytest.approx(2 / 6) and sum(w[0]) == pytest.approx(1)
    assert sum(w[1][1:]) == pytest.approx(0.7) and w[1][0] == pytest.approx(0.3)
    assert w[2] == pytest.approx([1 / 3] * 3) and w[3] == [0.5, 0.5] and w[4] == []


def test_random_others_equals_a_full_permutation(spark):
    rows, df = pool(spark, 40, concepts=4)
    import hashlib

    order = lambda i: (hashlib.md5(f"5|{i}".encode()).hexdigest(), i)
    got = {}
    for r in sampling.random_others(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id"), 4, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for q in rows:
        assert got[q[0]] == sorted([r[0] for r in rows if r[1] != q[1] and r[3] == q[3]], key=order)[:4]


def test_family_finds_what_nearest_misses(spark):
    rows = [("q", "q", 1, [1.0, 0.0]), ("far", "s", 1, [0.0, 1.0]), ("near", "n", 2, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id string, concept string, family int, vec array<double>").withColumn("part", F.lit("leaf"))
    q, d = df.where("id = 'q'").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")
    assert [r.doc_id for r in selection.nearest_others(q, d, 1).collect()] == ["near"]
    assert [r.doc_id for r in selection.nearest_in_group(q, d, 1, ["family", "part"]).collect()] == ["far"]
