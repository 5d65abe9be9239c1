import math
import random
import re
from collections import Counter

import pytest

from sorrel.llm import lexical
from sorrel.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, tf in tfs:
            m = 25 + 75 * sum(tf.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 3))) for _ in range(300)] + ["Zug", "zug", "Ä", "ä", "a1"]
    text = lambda most: " ".join(rng.choice(vocabulary[:rng.choice([5, 50, 305])]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(1, most)))
    docs = [(i, text(rng.choice([3, 40, 400]))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, "?!"), (None, "zug zug"), (5, docs[5][1]), (5, "a " * 3000)] + [(n + 10 + i, "the same copy zug") for i in range(n // 2)]
    items = [(i, text(30)) for i in range(25)] + [(3, "zug"), (90, None), (91, "!"), (92, "nowhere"), (93, "copy same copy zug"), (94, "a " * 500)]
    return items, docs


@pytest.mark.parametrize("docs_a_packet,lines,items_a_block", [(1024, 8, 256), (3, 1, 7)])
def test_against_brute_force(spark, monkeypatch, docs_a_packet, lines, items_a_block):
    """Also with signatures so crowded that nearly every bit is set: bounds stay bounds."""
    monkeypatch.setattr(lexical, "PACKET_DOCS", docs_a_packet)
    monkeypatch.setattr(lexical, "LINES_A_TERM", lines)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items_a_block)
    items, docs = corpus(lines, 200)
    got = lexical.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k=6)
    assert rows_of(got) == brute(items, docs, 6)


def test_bounds_hold_and_rule_out(spark):
    items, docs = corpus(3, 600)
    tfs = [Counter(lexical.words((t or "").encode())) for _, t in docs]
    n_docs, total = sum(map(bool, tfs)), sum(sum(c.values()) for c in tfs)
    df = Counter(t for c in tfs for t in c)
    block = lexical.Block([(i, t.encode()) for i, t in items if t], n_docs, total, df, 10)
    task = lexical._Task(block)
    for i, t in docs:
        task.add(i, (t or "").encode())
    for packet in task.packets.values():
        read = [Counter(lexical.words(t)) for t in packet.texts]
        for item, bound in lexical.bounds(block, packet):
            assert all(b >= block.exact(item, tf, n) for b, tf, n in zip(bound.tolist(), read, packet.sizes))
    list(task.finish())
    assert 0 < task.rescored < 0.2 * len(items) * len(docs)


def test_words_are_the_pattern():
    for text in ("Größe, naïve_x-y Z9\x00\t\u00a0b\u2028c", "\U0001d7d8a@B[c]`d{e}\x7ff", "", "ÀB"):
        assert [w.decode() for w in lexical.words(text.encode())] == terms(text)


def test_empty_sides_and_other_columns(spark):
    items = spark.createDataFrame([(1, "zug", 5)], "item_id long, text string, score int")
    docs = spark.createDataFrame([(1, "ein zug", 1), (2, "kein", 1), (3, "x" * 300_000 + " zug", 2)], "doc_id long, text string, rank int")
    assert [r["doc_id"] for r in lexical.search(items, docs).orderBy("rank").collect()] == [1, 3]
    assert lexical.search(items.limit(0), docs).count() == 0 and lexical.search(items, docs.limit(0)).count() == 0


def test_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    assert rows_of(QUERIES["op13_bit_sliced_search"](spark, sf)) == brute(read("benchmark", "item_id"), read("documents", "doc_id"), 10)
