import hashlib

import numpy as np

from sorrel import udf


def test_long_items_reach_the_function_in_small_batches(spark):
    def fn(texts):
        assert len(texts) <= 256
        return np.array([[len(t or "") + 1.0, int(hashlib.md5((t or "").encode()).hexdigest()[:4], 16)] for t in texts])

    rows = [(i, None if i % 7 == 0 else f"t{i}" * (i % 50)) for i in range(1500)]
    got = udf.embed_items(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text", fn, 2)
    found = {r["doc_id"]: r["vec"] for r in got.collect()}
    assert len(found) == 1500
    for i, t in rows:
        want = fn([t])[0]
        assert np.allclose(found[i], want / np.linalg.norm(want), rtol=1e-15)
