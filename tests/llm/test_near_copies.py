import random

import numpy as np
from pyspark.sql import functions as F
from test_simhash import plain_fingerprint

import corpus_pipeline
from sorrel.llm import nearcopies

SF = "/root/testdata/sf0.01"


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def stays(texts):
    """Ids that lead their component, links by brute force over all pairs."""
    sets, fp = {i: plain_set(t) for i, t in texts.items()}, {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            near = (fp[a] ^ fp[b]).bit_count() <= 3
            if near or (5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stage(spark, docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == stays({r["doc_id"]: r["text"] for r in docs.collect()})


def test_edited_copies_go_and_unlike_texts_stay(spark):
    dice = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts, copies = {}, set()
    for i in range(40):
        base = [dice.choice(words) for _ in range(400)]
        texts[i] = " ".join(base)
        for j in range(3):
            edited = list(base)
            for p in dice.sample(range(400), 3 * (j + 1) - 1):
                edited[p] = dice.choice(words)
            assert jaccard(plain_set(texts[i]), plain_set(" ".join(edited))) >= 0.8
            texts[1000 + 3 * i + j] = " ".join(edited)
            copies.add(1000 + 3 * i + j)
        half = base[:200] + [dice.choice(words) for _ in range(200)]
        texts[5000 + i] = " ".join(half)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r["doc_id"] for r in stage(spark, docs).collect()}
    assert left == texts.keys() - copies == stays(texts)


def test_chains_reach_across_bands(spark):
    """Each text is like the next one only, so most pairs of a band are unlike."""
    words = [f"v{i}" for i in range(1200)]
    texts = {i: " ".join(words[20 * i:20 * i + 300]) for i in range(40)}
    texts |= {100: None, 101: "", 102: "two words", 103: "two words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in stage(spark, docs).collect()} == stays(texts) == {0, 100, 102}


def test_prefixes_meet_exactly():
    """Alike sets share a key, whatever the counts say; the places allow every alike pair."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        base = rng.integers(0, 1 << 63, n + 20, np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[int(rng.integers(0, n // 5 + 1)):n + int(rng.integers(0, n // 5 + 1))])
        counts = rng.integers(0, 4, 64).astype(np.uint32)
        if nearcopies.alike(a, b):
            p, q = nearcopies.prefix(a, counts).tolist(), nearcopies.prefix(b, counts).tolist()
            first = next(x for x in p if x in q)
            left = min(len(a) - p.index(first), len(b) - q.index(first))
            assert 9 * left >= 4 * (len(a) + len(b))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((0, 3), (50, 5), (300, 300)):
        base = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
        a, b = base[:n], base[m:]
        words = zip(nearcopies.parities(a), nearcopies.parities(b))
        assert sum(((x ^ y) & (2 ** 64 - 1)).bit_count() for x, y in words) <= len(np.setxor1d(a, b))


def family(n, words, share, seed):
    """Texts edited from one base, each word replaced with probability ``share``."""
    dice = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    return [" ".join(w if dice.random() >= share else f"e{dice.randrange(10 ** 9)}" for w in base) for _ in range(n)]


def test_template_family_is_hardly_compared(spark, monkeypatch):
    """400 texts of similarity about 0.56 share most keys' words but few are compared."""
    seen = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    texts = dict(enumerate(family(400, 300, 0.03, 1)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in stage(spark, docs).collect()} == stays(texts)
    assert sum(seen) < 0.05 * 400 * 399 / 2, seen


def test_masses_of_near_copies_take_linear_comparisons(spark, monkeypatch):
    seen = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    texts = dict(enumerate(family(600, 300, 0.002, 2)))
    docs = spark.createDataFrame([(3 if i % 3 == 0 else i, t) for i, t in texts.items()], "doc_id long, text string").repartition(6)
    assert {r["doc_id"] for r in stage(spark, docs).collect()} == {1}
    assert sum(seen) < 20 * 600, seen


def edited(n, words, most, seed, first=0):
    """Texts edited from one base, each in up to ``most`` words; the base itself comes first, if it is asked for."""
    dice = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = [" ".join(base)] * first
    for i in range(n):
        text = list(base)
        for p in dice.sample(range(words), i % most + 1):
            text[p] = f"e{dice.randrange(10 ** 9)}"
        texts.append(" ".join(text))
    return texts


def test_family_around_a_base_takes_linear_comparisons(spark, monkeypatch):
    """Most pairs of the least edited are alike, pairs of the others are not: neither makes rows by the square."""
    seen = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    texts = dict(enumerate(edited(400, 150, 5, 3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in stage(spark, docs).collect()} == stays(texts)
    assert sum(seen) < 4 * 400, seen


def test_blocks_of_a_crowded_key_miss_no_pair(spark, monkeypatch):
    texts = dict(enumerate(edited(150, 150, 6, 4) + edited(60, 40, 2, 5)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    base = nearcopies.id_text(docs)
    prints = nearcopies._signatures(base).cache()
    members, _ = nearcopies.candidates(nearcopies._keys(base))
    rows = members.withColumn("root", F.pmod("s", F.lit(7))).cache()
    whole = {tuple(r) for r in nearcopies.crossing(rows, prints).collect()}
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    monkeypatch.setattr(nearcopies, "CHUNK", 64)
    monkeypatch.setattr(nearcopies, "PACKET_ROWS", 500)
    assert {tuple(r) for r in nearcopies.crossing(rows, prints).collect()} == whole
    sets = {nearcopies.digest(f): f for f in map(nearcopies.shingles, texts.values())}
    pairs = {tuple(sorted(r[:2])) for r in whole}
    alike = {(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and nearcopies.alike(sets[a], sets[b])}
    assert alike and alike <= pairs and len(pairs) < 2 * len(alike)


def test_keys_of_sets():
    found = nearcopies.shingles("a b c d e f " * 3)
    assert len(found) == 6 and len(nearcopies.prefix(found, np.zeros(8, np.uint32))) == 2
    assert len(nearcopies.shingles(" ")) == 0 and len(nearcopies.shingles("A b")) == 1
    assert (nearcopies.shingles("A B") == nearcopies.shingles("a  b")).all()


def test_a_worker_keeps_no_words_of_the_texts_it_has_seen():
    from sorrel.llm import repeats

    for i in range(300):
        text = " ".join(f"w{i}x{j}" for j in range(10))
        nearcopies.shingles(text)
        repeats.encoded(text, repeats.WORD)
    assert not [k for m in (nearcopies, repeats) for k, v in vars(m).items() if k != "__builtins__" and isinstance(v, dict) and len(v) > 1000]
