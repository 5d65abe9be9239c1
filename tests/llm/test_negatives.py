import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sorrel.llm import negatives
from sorrel.llm.queries import QUERIES


def brute(rows, anchors, k=5, low=80, high=100):
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
            if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, label in good:
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, c) for i, v, c in good if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 1 << 21), st.integers(0, 1000))
def test_products_are_exact(width, peak, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-peak, peak + 1, (5, width)), rng.integers(-peak, peak + 1, (7, width))
    a[0], b[0], b[1] = peak, peak, -peak
    primes = negatives.primes_for(width * peak * peak)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


def test_primes_grow_with_the_bound():
    assert negatives.primes_for(10) == [1021] and len(negatives.primes_for(1 << 23)) == 3
    assert (negatives.SPAN * (negatives.LARGEST_PRIME // 2) ** 2 + negatives.LARGEST_PRIME) < 1 << 24


@pytest.mark.parametrize("numbers", [1 << 20, 12])
def test_against_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(negatives, "CELLS", 64 if numbers == 12 else 1 << 21)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0.4, 0.5, 6)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, [0.5, 0.5, -0.25, 0.5, 1.0, 0.0], i % 2) for i in range(300, 500)]  # two fifths are one vector
    rows += [(600, [0.0] * 6, 1), (700, [-1.0] * 6, 1), (701, None, 1), (800, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (None, [1.0] * 6, 1),
             (900, [1.0] * 6, None), (1000, [float("nan")] * 6, 0), (1100, [float("inf")] + [0.0] * 5, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(5)
    got = negatives.mine(df.where("vec_id % 100 = 0"), df, anchor_numbers=numbers)
    want = brute(rows, {i for i, _, _ in rows if i is not None and i % 100 == 0})
    assert want and rows_of(got) == want


def test_a_third_under_one_id(spark):
    rng = np.random.default_rng(6)
    rows = [(7 if i % 3 == 0 else i, [float(x) for x in rng.integers(0, 3, 4)], int(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = rows_of(negatives.mine(df.where("vec_id in (1, 7, 100)"), df, scale=1.0, anchor_numbers=40))
    one = [r for r in got if r[0] in (1, 100)]
    good = [(i, v, c) for i, v, c in rows]
    for a in (1, 100):
        q, label = next((v, c) for i, v, c in good if i == a)
        scored = sorted((-int(np.dot(q, v)), i, c) for i, v, c in good if i != a)
        best = [x for x in scored if x[2] == label][:5]
        want = []
        for s, p, _ in best:
            fit = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            want += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
        assert [r for r in one if r[0] == a] == sorted(want)
    assert not any(r[0] == 7 and 7 in (r[1], r[3]) for r in got)


def test_few_rows_empty_and_errors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.0], 2)], schema)
    assert rows_of(negatives.mine(df.where("vec_id = 0"), df)) == [(0, 1, 1, 2, 65536, 58880)]
    assert negatives.mine(df.limit(0), df).count() == 0 and negatives.mine(df, df.limit(0)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], schema)
    assert negatives.mine(alone, alone).count() == 0
    with pytest.raises(ValueError, match="different lengths"):
        negatives.mine(df, spark.createDataFrame([(5, [1.0], 1)], schema))
    with pytest.raises(ValueError, match="beyond"):
        huge = spark.createDataFrame([(0, [1e30], 1)], schema)
        negatives.mine(huge, huge)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["label"] is not None and r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op11_residue_negatives"](spark, sf)) == brute(rows, {i for i, _, _ in rows if i % 100 == 0})
