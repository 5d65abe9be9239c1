"""Concept mentions by one automaton and by n-grams, against plain word matching."""

import random

import pytest

from sorrel.operators import corpus


@pytest.mark.parametrize("few_bytes", [32 << 20, 0])
def test_both_ways_find_the_same_mentions(spark, monkeypatch, few_bytes):
    monkeypatch.setattr(corpus, "_BROADCAST_BYTES", few_bytes)
    dice = random.Random(6)
    words = ["a", "ab", "red", "fox", "Red", "ö", "x1", "sea"]
    concepts = ["a", "red fox", "fox red fox", "Red  Fox", "ab a", "ö x1", "sea", "never there", "a a a"]
    texts = [" ".join(dice.choice(words) + dice.choice(["", "", "", ",", "."]) for _ in range(dice.randint(1, 9))) for _ in range(150)] + ["", None, "a a a a"]
    got = {(r["id"], r["concept"]) for r in corpus.phrase_matches(
        spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(c,) for c in concepts], "concept string"), "id").collect()}
    want = set()
    for i, t in enumerate(texts):
        line = "".join(c if c.isalnum() or c == " " else " | " for c in (t or "").lower()).split()
        for c in concepts:
            p = c.lower().split()
            if any(line[j:j + len(p)] == p for j in range(len(line) - len(p) + 1)):
                want.add((i, c))
    assert got == want and len(want) > 100


def test_no_caption_is_shuffled_for_odd_concepts(spark):
    caps = spark.createDataFrame([(1, "Eau, d'eau verte"), (2, "d eau"), (2, "l'eau D'Eau"), (3, " eau verte d"), (4, None), (5, " ")], "id long, text string")
    concepts = spark.createDataFrame([(c,) for c in ("d'eau", "eau verte", "!!!", "d", "L'Eau")], "concept string")
    found = corpus.phrase_matches(caps, concepts, "id")
    assert sorted((r["id"], r["concept"]) for r in found.collect()) == [
        (1, "d"), (1, "d'eau"), (1, "eau verte"), (2, "L'Eau"), (2, "d"), (2, "d"), (2, "d'eau"), (3, "d"), (3, "eau verte")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
