"""Capped search: few rows are scored exactly however few tags there are, and small groups need no pivots."""

import numpy as np
import pyarrow as pa
import pytest

from sorrel.operators import selection, similarity


def scores(m):
    s = np.zeros((len(m), len(m)))
    for j in range(m.shape[1]):
        s += m[:, None, j] * m[None, :, j]
    return s


def walk(s, tags, i, k, cap, ok=lambda j: True):
    per, want = {}, []
    for j in np.lexsort((np.arange(len(s)), -s[i])):
        if len(want) < k and tags[j] != tags[i] and ok(j) and per.get(tags[j], 0) < cap:
            per[tags[j]] = per.get(tags[j], 0) + 1
            want.append((int(j), float(s[i, j])))
    return want


def sides(m, tags):
    vec = pa.array(m.tolist(), pa.list_(pa.float64()))
    ids, tag = pa.array(range(len(m)), pa.int64()), pa.array([str(t) for t in tags])
    return pa.table({"_qid": ids, "_qtag": tag, "_qvec": vec}), pa.table({"_cid": ids, "_ctag": tag, "_cvec": vec})


@pytest.mark.parametrize("hot", [0, 500])
@pytest.mark.parametrize("n_tags,k,cap", [(2, 4, 2), (3, 8, 1), (5, 3, 2), (10, 8, 2), (1600, 4, 2)])
def test_few_rows_are_scored_exactly(monkeypatch, n_tags, k, cap, hot):
    scored, dot = [], similarity._sequential_dot
    monkeypatch.setattr(similarity, "_sequential_dot", lambda q, c, qi, ci: scored.append(len(qi)) or dot(q, c, qi, ci))
    rng = np.random.default_rng(n_tags + hot)
    m, tags = rng.normal(size=(1600, 6)), rng.integers(0, n_tags, 1600)
    m[rng.permutation(1600)[:hot]] = m[0] * 5
    out = similarity._topk_kernel(k, cap)(*sides(m, tags))
    if n_tags < 1600:
        assert sum(scored) < 2 * k * cap * 1600
    got, s = {}, scores(m)
    for q, c, score in sorted(zip(out["_qid"].to_pylist(), out["_cid"].to_pylist(), out["_score"].to_pylist()), key=lambda h: (h[0], -h[2], h[1])):
        got.setdefault(q, []).append((c, score))
    assert all(got.get(i, []) == walk(s, tags, i, k, cap) for i in range(0, 1600, 7))


def test_no_tag_equals_none():
    m = np.random.default_rng(2).normal(size=(90, 4))
    left, right = sides(m, [0] * 90)
    none = pa.nulls(90, pa.string())
    out = similarity._topk_kernel(5, 3)(left.set_column(1, "_qtag", none), right.set_column(1, "_ctag", none))
    best = np.argsort(-scores(m), axis=1, kind="stable")[:, :3]
    assert sorted(zip(out["_qid"].to_pylist(), out["_cid"].to_pylist())) == sorted((i, int(j)) for i in range(90) for j in best[i])


def test_groups_within_a_block_are_compared_at_once(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("pivots for groups that are one block each")

    monkeypatch.setattr(similarity, "Blocks", never)
    monkeypatch.setattr(similarity, "cut", never)
    m = np.random.default_rng(3).normal(size=(400, 6))
    df = spark.createDataFrame([(i, i % 10, i % 5, i % 4, [float(x) for x in v]) for i, v in enumerate(m)],
                               "id long, concept long, family long, part long, vec array<double>").repartition(4)
    q, d = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")
    got, s, tags = {}, scores(m), np.arange(400) % 10
    hits = selection.nearest_in_group(q, d, 4, ["family", "part"], block_rows=100).collect()
    for h in sorted(hits, key=lambda h: h["rank"]):
        got.setdefault(h["query_id"], []).append((h["doc_id"], h["score"]))
    assert [got.get(i, []) for i in range(400)] == [walk(s, tags, i, 4, 2, lambda j: j % 5 == i % 5 and j % 4 == i % 4) for i in range(400)]
