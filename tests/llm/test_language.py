import base64
import random
import zlib
from collections import Counter

from sorrel.llm import language
from sorrel.llm.queries import QUERIES


def plain_rank(text, size=language.PROFILE):
    counts = Counter()
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            m = f"_{word}_"
            counts.update(word)
            for n in (2, 3):
                counts.update(m[i:i + n] for i in range(len(m) - n + 1))
            word = ""
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


def test_profile_and_distance_match_plain():
    grams = language._Grams()
    texts = ["", None, "1234 !?", "Der Öl-Tank, der ROTE.", "aa aa ab", "x" * 500, "The cat " * 100 + "sat on mats " * 3]
    for t in texts:
        assert language.ranked(language.gram_counts(t, grams)) == plain_rank(t)
        assert language.ranked(language.gram_counts(t, grams), 5) == plain_rank(t, 5)
    profiles = {"a": plain_rank(texts[3]), "b": plain_rank(texts[6])}
    p = language.Profiles(profiles)
    for t in texts:
        doc = plain_rank(t)
        dist = {k: sum(abs(i - v.index(g)) if g in v else 300 for i, g in enumerate(doc)) for k, v in profiles.items()}
        want = min(dist, key=lambda k: (dist[k], k)) if doc else "und"
        got, score = p.nearest(doc)
        assert got == want and 0 <= score <= 1
        assert not doc or abs(score - (1 - dist[want] / (300 * len(doc)))) < 1e-12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op6_rank_order_language"](spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    held = [i for i, r in got.items() if r["held_out"]]
    assert sorted(held) == sorted(i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.95
    assert language.keep_identified(docs).count() == docs.count()


def test_odd_rows(spark):
    rows = [(i, "der die das und nicht " * 3, "de", 1.0) for i in range(9)] + [(20 + i, "the and of with this " * 3, "en", 1.0) for i in range(9)]
    rows += [(None, "the and of", "en", 0.0), (50, None, "de", 0.0), (51, "", None, 0.0), (52, "123 ...", "xx", 0.0), (52, "und nicht das", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = language.predict(docs)
    got = {(r["doc_id"], r["lang_pred"], r["held_out"]) for r in out.collect() if r["doc_id"] is None or r["doc_id"] >= 50}
    h = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (50, 51, 52)}
    assert got == {(None, "en", False), (50, "und", h[50]), (51, "und", h[51]), (52, "und", h[52]), (52, "de", h[52])}
    assert {r["score"] for r in out.where("lang_pred = 'und'").collect()} == {0.0}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert language.predict(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false").unionByName(docs.where("lang IS NULL"))).collect()} == {"und"}


def test_gibberish_and_an_unlearned_language_go(spark):
    dice = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = lambda n: " ".join("".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(dice.randint(2, 9))) for _ in range(n))
    odd = {-1: letters(60), -2: base64.b64encode(dice.randbytes(600)).decode(), -3: "Это предложение написано по-русски и должно исчезнуть.",
           -4: "Wszystkie dzieci w szkole uczyły się wczoraj nowych słów, a potem poszły do domu przez park, gdzie rosły stare drzewa i kwiaty, "
               "bo chciały jeszcze chwilę pobawić się na świeżym powietrzu przed kolacją", -5: None, -6: "12 34"}
    more = spark.createDataFrame(list(odd.items()), "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    kept = {r["doc_id"] for r in language.keep_identified(docs.unionByName(more)).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_numbered_ranks_are_those_of_the_plain_list():
    texts = ["", None, "1234 !?", "Der Öl-Tank, der ROTE.", "aa aa ab", "x" * 500, "İ ß 中文 𝒜𝒷 a", "The cat " * 100 + "sat on mats " * 3]
    p = language.Profiles({"a": plain_rank(texts[3]), "b": plain_rank(texts[7])})
    for t in texts:
        for words in (1 << 16, 7):
            assert language.ranked_numbers(t, words_at_once=words).tolist() == [language._number(g) for g in plain_rank(t)]
        assert p.nearest_numbers(language.ranked_numbers(t)) == p.nearest(plain_rank(t))
