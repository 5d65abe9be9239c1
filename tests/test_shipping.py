import numpy as np

from sorrel.operators import blocks, density, similarity


def _frame(spark, m):
    return spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(m)], "id long, part long, vec array<double>")


def test_a_row_without_structure_is_shipped_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_ROWS", 32)
    sent, route = [], blocks.Blocks.route
    monkeypatch.setattr(blocks.Blocks, "route", lambda self, *a: (lambda out: sent.append(out.count()) or out)(route(self, *a)))
    for n in (500, 1500):
        m = np.random.default_rng(n).normal(size=(n, 24))
        df = _frame(spark, m)
        q, d = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")
        hits = {r["query_id"]: r["doc_id"] for r in similarity.top_k(q, d, 1).collect()}
        assert hits == dict(enumerate(np.argmax(m @ m.T, axis=1).tolist()))
        assert sum(sent) <= blocks.SIDE_BLOCKS * n
        sent.clear()


def test_later_rounds_of_a_tree_ask_only_for_open_vectors(spark, monkeypatch):
    asked, search = [], density.top_k

    def counting(q, d, *args, **kwargs):
        asked.append(q.count())
        return search(q, d, *args, **kwargs)

    monkeypatch.setattr(density, "top_k", counting)
    m = np.random.default_rng(7).normal(size=(300, 6))
    links = density.spanning_tree(_frame(spark, m), block_rows=64).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids, score = np.arange(300), unit @ unit.T
    lo, hi, _ = density._tree(ids, unit)
    assert {(r["lo"], r["hi"]) for r in links} == set(zip(lo.tolist(), hi.tolist())) and len(links) == 299
    # every first hit becomes a link, so the second round asks for all once more
    assert asked[:2] == [300, 300] and len(asked) > 2 and all(a < 200 for a in asked[2:])
