import math

import numpy as np
import pytest

from sorrel.functions import scores
from sorrel.operators import paired


def _ranks(values):
    counts = np.unique(values, return_counts=True)[1]
    return 2 * np.cumsum(counts) - counts + 1, counts


@pytest.mark.parametrize("levels", [None, 40, 2, 1])
def test_inverted_tail_equals_the_built_distribution(levels, monkeypatch):
    rng = np.random.default_rng(4)
    twice, pairs = _ranks(rng.random(120) if levels is None else rng.integers(0, levels, 200))
    total = int((twice * pairs).sum())
    built = [scores._pairwise_tail(twice, pairs, math.ceil(2 * (share * total / 2))) for share in (0.3, 0.5, 0.6, 0.9, 1.0)]
    monkeypatch.setattr(scores, "_PAIRWISE", 0)
    found = [scores.signed_rank_tail(twice, pairs, share * total / 2) for share in (0.3, 0.5, 0.6, 0.9, 1.0)]
    assert found == pytest.approx(built, rel=1e-9)


def test_exact_tail_of_many_pairs():
    twice, pairs = _ranks(np.arange(20_000))
    sd = math.sqrt(float((twice.astype(float) ** 2).sum())) / 4
    tail = scores.signed_rank_tail(twice, pairs, twice.sum() / 4 + 1.5 * sd)
    assert tail == pytest.approx(0.5 * math.erfc(1.5 / math.sqrt(2)), rel=1e-4)


def test_large_keys_never_reach_the_exact_recursion(spark):
    rows = spark.range(30_000).selectExpr("id % 3 as k", "(id + 1) * if(hash(id) % 2 = 0, 1.0D, -1.0D) as delta")
    found = paired.wilcoxon(rows, ["k"]).collect()
    assert [r.n_nonzero for r in found] == [10_000] * 3
    for r in found:
        assert r.p_greater == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)))
