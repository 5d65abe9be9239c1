"""Pivot blocks: bounds hold, results stay exact, and far blocks are not visited."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.operators import blocks, similarity


def clustered(n, clusters, dim=8, seed=0, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 4
    m = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.2
    m[:hot] = m[0]
    return m


def frame(spark, m, tags=None):
    rows = [(i, int(tags[i]) if tags is not None else i, int(i % 2), [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, tag long, part long, vec array<double>").repartition(4)


def exact(m):
    s = np.zeros((len(m), len(m)))
    for j in range(m.shape[1]):
        s += m[:, None, j] * m[None, :, j]
    return s


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for scale in (1e-6, 1.0, 1e6):
        m = rng.normal(size=(200, 5)) * scale
        c = rng.normal(size=(7, 5)) * scale
        own = blocks._nearest(m, c)
        r = np.array([np.sqrt(((m[own == j] - c[j]) ** 2).sum(axis=1)).max(initial=0.0) for j in range(7)])
        assert (blocks.upper_bounds(m, c, r)[:, own] >= exact(m)).all()


@pytest.mark.parametrize("cap,grouped,hot", [(None, False, 0), (1, False, 400), (None, True, 400), (2, True, 0)])
def test_top_k_is_exact(spark, cap, grouped, hot):
    m = clustered(1200, 20, seed=hot + 1, hot=hot)
    tags = np.arange(1200) % 40
    df = frame(spark, m, tags)
    q, d = df.withColumnRenamed("id", "query_id").where("query_id % 5 = 0"), df.withColumnRenamed("id", "doc_id")
    got = {}
    for h in sorted(similarity.top_k(q, d, 4, tag="tag", cap=cap, group="part" if grouped else None, block_rows=64).collect(), key=lambda h: h["rank"]):
        got.setdefault(h["query_id"], []).append((h["doc_id"], h["score"]))
    s = exact(m)
    for i in range(0, 1200, 5):
        want, per = [], {}
        for j in np.lexsort((np.arange(1200), -s[i])):
            if tags[j] != tags[i] and (not grouped or j % 2 == i % 2) and per.get(tags[j], 0) < (cap or 1200) and len(want) < 4:
                per[tags[j]] = per.get(tags[j], 0) + 1
                want.append((int(j), float(s[i, j])))
        assert got[i] == want


def test_visits_do_not_grow_with_the_rows(spark, monkeypatch):
    """On clustered vectors a query visits a few blocks, however many there are."""
    sent = []
    route = blocks.Blocks.route
    monkeypatch.setattr(similarity, "cut", lambda df: df.cache())
    monkeypatch.setattr(blocks.Blocks, "route", lambda self, *a: (lambda out: sent.append((out.count(), self.meta.count())) or out)(route(self, *a).cache()))
    for n in (3000, 12000):
        df = frame(spark, clustered(n, 40, dim=12, seed=5))
        q, d = df.withColumnRenamed("id", "query_id").where(f"query_id % {n // 300} = 0"), df.withColumnRenamed("id", "doc_id")
        assert similarity.top_k(q, d, 5, tag="tag", block_rows=128).count() == 5 * 300
    for (first, few), (later, _) in (sent[:2], sent[2:]):
        print("visits of 300 queries:", first, "+", later, "of", few * 300, "block pairs")
        assert first + later < 8 * 300 and few > 20


def test_counts_above_a_mark(spark):
    m = clustered(900, 12, seed=8)
    s = exact(m)
    mark = np.sort(s, axis=1)[:, -6]
    df = frame(spark, m).join(spark.createDataFrame([(i, float(x), i % 900) for i, x in enumerate(mark)], "id long, mark double, mark_id long"), "id")
    q, d = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")
    got = {r["query_id"]: r["n_above"] for r in similarity.count_above(q, d, "mark", "mark_id", tag="tag", block_rows=50).collect()}
    for i in range(900):
        assert got[i] == sum(1 for j in range(900) if j != i and (s[i, j] > mark[i] or s[i, j] == mark[i] and j < i))
    far = q.withColumn("mark", F.lit(1e9))
    assert {r["n_above"] for r in similarity.count_above(far, d, "mark", "mark_id", tag="tag", block_rows=50).collect()} == {0}


def test_forest_skips_far_blocks(spark):
    m = clustered(1500, 25, dim=6, seed=9)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = frame(spark, m)
    side = blocks.Blocks(similarity._side(df, "c", "id", "vec", None, None), 1500, 60, False)
    pairs, n = side.close_pairs(0.97).count(), side.meta.count()
    print("block pairs compared:", pairs, "of", n * (n + 1) // 2)
    assert pairs < 0.3 * n * (n + 1) / 2
    root = list(range(1500))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(exact(m) >= 0.97)):
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = list(range(1500))

    def found(i):
        while got[i] != i:
            i = got[i]
        return i

    for e in similarity.threshold_forest(df, 0.97, block_rows=60).collect():
        a, b = found(e["u"]), found(e["v"])
        got[max(a, b)] = min(a, b)
    assert [found(i) for i in range(1500)] == [find(i) for i in range(1500)]
