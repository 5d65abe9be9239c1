import numpy as np
import pytest

from sorrel.llm import neighbours
from sorrel.llm.queries import QUERIES


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in good:
        if i in queries:
            scored = sorted(((-float(sum(a * b for a, b in zip(q, v))), j) for j, v in good if j != i))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    m = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in QUERIES["op3_kmeans_tree_search"](spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    hit = total = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        s = m @ m[ids == i][0]
        assert all(abs(s[ids == j][0] - x) < 1e-12 for _, j, x in found)
        s[ids == i] = -np.inf
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(true & {f[1] for f in found}), total + 20
    assert hit / total >= 0.9, hit / total


@pytest.mark.parametrize("packet", [None, 7])
def test_ties_copies_and_odd_rows(spark, monkeypatch, packet):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 8)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5 if packet else 4096)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 50.0]) for i in range(60)] + [(7, [9.0, 9.0, 9.0, 9.0])]
    rows += [(None, [1.0] * 4), (300, None), (320, [0.0] * 4), (340, [1.0, None, 2.0, 3.0]), (360, [float("nan"), 1.0, 1.0, 1.0]), (380, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    out = neighbours.search(df.where("vec_id % 20 = 0"), df, 9, target_recall=1.0, packet=packet).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 9)
    assert got.keys() == want.keys()
    right = sum(a == b for i in want for a, b in zip(got[i], want[i]))
    assert right == sum(map(len, want.values()))


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [1e200, 1e200])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df.where("vec_id % 20 = 0"), df, 20).collect())
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 1), (20, 2, 0)]
    assert neighbours.search(df.limit(0), df, 20).count() == 0 and neighbours.search(df, df.limit(0), 20).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        bad = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5])], "vec_id long, embedding array<double>")
        neighbours.search(bad, bad, 2).count()
