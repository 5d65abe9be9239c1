import hashlib
import math
import zlib
from collections import Counter, defaultdict

from sorrel.llm import sharding


def bids(key, weights):
    out = []
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        out.append(w / -math.log(u))
    return out


def test_placing_and_slots(spark):
    weights = (1.0, 2.0, 0.0, 3.0)
    rows = [(i * 7919 % 100_003, None if i % 50 == 0 else "é" * (i % 4)) for i in range(3000)] + [(None, "x"), (5, "a"), (5, "a"), (5, "b")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, size int, shard string").repartition(5)
    for per_bucket in (4096, 20):
        out = sharding.shard_records(docs, weights, 2.0, rows_per_bucket=per_bucket).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        slots = defaultdict(list)
        for r in out:
            key = "" if r["doc_id"] is None else r["doc_id"]
            b = bids(key, weights)
            assert r["shard"] == b.index(max(b)) and r["law"] == "key"
            grown = bids(key, (*weights, 2.0))
            assert r["grown_shard"] == grown.index(max(grown)) and r["grown_shard"] in (r["shard"], 4)
            slots[r["shard"]].append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
        for s in slots.values():
            assert [x[0] for x in sorted(s)] == list(range(len(s))) and [x[1] for x in sorted(s)] == sorted(x[1] for x in s)
        share = {s: len(v) / len(rows) for s, v in slots.items()}
        assert 2 not in share and all(abs(share[s] - weights[s] / 6) < 0.04 for s in share)
        moved = sum(r["grown_shard"] != r["shard"] for r in out) / len(rows)
        assert abs(moved - 2 / 8) < 0.04


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert sharding.shard_records(docs).count() == 0
