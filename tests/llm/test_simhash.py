import random

import numpy as np
import pytest
import xxhash

from sorrel.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fp = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (fp[i], find(i)) for i in ids}


def test_fingerprint_matches_plain():
    rng = random.Random(1)
    for text in [None, "", " \t\x0b", "One", "a B", "ÉÀ x\x1fy z", "a b c d a b c d"] + [
            " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))) for _ in range(30)]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_code_is_perfect_and_six_or_one_keys():
    words = np.arange(1 << 12, dtype=np.int64) << 11
    codewords = words ^ simhash._syndromes(words)
    leader, four = simhash._tables()
    assert (leader[1:] > 0).all() and {len(f) for f in four} == {0, 5}
    assert (simhash.own_index(codewords) == np.arange(1 << 12)).all()
    assert (simhash.own_index(codewords ^ 0b1000100000000000000001) == np.arange(1 << 12)).all()


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [simhash.fuzzy_keys(x.view(np.int64)) for x in (a, b)]
    offered, sought = [set() for _ in a], [set() for _ in a]
    for sets, (at, key, side), wanted in ((offered, keys[0], 0), (sought, keys[1], 1)):
        for i, k, s in zip(at.tolist(), key.tolist(), side.tolist()):
            if s == wanted:
                sets[i].add(k)
    assert all(x & y for x, y in zip(offered, sought))


@pytest.mark.parametrize("block", [1024, 5])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 50)) for _ in range(220)]
    rows = [(900, None), (901, ""), (5, "one"), (6, "ONE"), (7, "one two")]
    for i in range(60):
        words = list(base) if i % 2 else [f"w{rng.randint(0, 99)}" for _ in range(60)]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 9))
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int").repartition(3)
    got = {r["doc_id"]: (r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in simhash.components(docs).collect()}
    want = plain_components(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.components(docs).collect() if r["component_id"])
    assert got == [(0, 3), (3, 3), (3, 3)]
    assert simhash.drop_near_duplicates(docs).count() == 4
    assert simhash.components(docs.limit(0)).count() == 0
