"""Density hubs against a plain top-down condensation of the single-link hierarchy."""

import numpy as np
import pytest

from sorrel.operators import density, groups


def plain(ids, m, least):
    """Labels by the textbook: sort all pairs, link, condense from the root down, keep the stablest clusters."""
    n = len(ids)
    s = np.zeros((n, n))
    for j in range(m.shape[1]):
        s += m[:, None, j] * m[None, :, j]
    pairs = sorted((np.sqrt(max(2.0 - 2.0 * s[i, j], 0.0)), min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(n) for j in range(i))
    pairs.sort(key=lambda p: (-s[p[3], p[4]], p[1], p[2]))
    sets, tree = {i: (i,) for i in range(n)}, None
    owner = list(range(n))
    nodes = {i: (i, None, None, 0.0) for i in range(n)}
    for d, _, _, i, j in pairs:
        a, b = owner[i], owner[j]
        if a != b:
            new = len(nodes)
            nodes[new] = (None, a, b, d)
            sets[new] = sets[a] + sets[b]
            for p in sets[new]:
                owner[p] = new
            tree = new
    if tree is None:
        return dict.fromkeys(ids, -1)

    def walk(top, birth):
        """(stability, kept, members) of the cluster that begins at ``top``."""
        total, node = 0.0, top
        while True:
            _, a, b, d = nodes[node]
            lam = 1 / max(d, density.CLOSEST)
            big = [x for x in (a, b) if len(sets[x]) >= least]
            if len(big) == 2:
                total += len(sets[node]) * (lam - birth)
                inner = [walk(x, lam) for x in big]
                below = sum(x[0] for x in inner)
                return (total, [sets[top]]) if total >= below and birth > 0 else (below, sum((x[1] for x in inner), []))
            if not big:
                total += len(sets[node]) * (lam - birth)
                return (total, [sets[top]]) if birth > 0 else (0.0, [])
            total += (len(sets[node]) - len(sets[big[0]])) * (lam - birth)
            node = big[0]

    out = dict.fromkeys(ids, -1)
    for members in walk(tree, 0.0)[1] if len(sets[tree]) >= least else []:
        for p in members:
            out[ids[p]] = min(ids[q] for q in members)
    return out


def points(n, clusters, seed, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(clusters, 5))[rng.integers(0, clusters, n)] + rng.normal(size=(n, 5)) * rng.choice([0.05, 0.2, 0.6], n)[:, None]
    if copies:
        m[:copies] = m[0]
    return m


def unit_rows(m):
    out = []
    for v in m:
        t = 0.0
        for x in v:
            t += x * x
        out.append([x / np.sqrt(t) for x in v])
    return np.array(out)


@pytest.mark.parametrize("block_rows,fold_edges,copies", [(2048, 50_000, 0), (2048, 20, 0), (40, 15, 0), (2048, 50_000, 40)])
def test_hubs_are_the_condensed_clusters(spark, block_rows, fold_edges, copies):
    n = 240
    m = points(n, 12, 3 + copies, copies)
    ids = [7 * i % 1009 for i in range(n)]
    df = spark.createDataFrame([(ids[i], i % 2, [float(x) for x in m[i]]) for i in range(n)], "id long, part long, vec array<double>").repartition(4)
    got = {r["id"]: r["hub_id"] for r in density.density_hubs(df, block_rows=block_rows, fold_edges=fold_edges).collect()}
    own = unit_rows(m)
    for part in (0, 1):
        at = [i for i in range(n) if i % 2 == part]
        want = plain([ids[i] for i in at], own[at], 3)
        assert {i: got[i] for i in want} == want
        if not copies:
            assert len(set(want.values())) > 5 and -1 in want.values()


def test_few_points_nulls_and_empty(spark):
    schema = "id long, part long, vec array<double>"
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 1, [0.0, 1.0]), (4, None, [1.0, 1.0]), (5, 0, None)]
    df = spark.createDataFrame(rows, schema)
    assert {(r["id"], r["hub_id"]) for r in density.density_hubs(df).collect()} == {(i, -1) for i in range(1, 6)}
    assert density.density_hubs(df.limit(0)).count() == 0


def test_hub_tables_by_density(spark):
    m = points(150, 6, 9)
    df = spark.createDataFrame([(i, 0, i % 10, [float(x) for x in unit_rows(m[i:i + 1])[0]]) for i in range(150)], "id long, part long, concept long, vec array<double>")
    hub, member = groups.hub_tables(df, None)
    labels = {r["id"]: r["hub_id"] for r in density.density_hubs(df).collect()}
    hubs = {r["hub_id"] for r in hub.collect()}
    assert hubs and {(r["hub_id"], r["instance_id"]) for r in member.collect()} == {(h, i) for i, h in labels.items() if h in hubs}
