import random

from sorrel.llm import language


def test_profiles_and_threshold_come_from_all_rows(spark, monkeypatch):
    dice = random.Random(2)
    words = {"de": "der die das und nicht ein haus baum".split(), "en": "the and of with this that house tree".split()}
    rows = [(i, " ".join(dice.choices(words[lang], k=12)), lang) for lang in words for i in dice.sample(range(100_000), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.learn_profiles(docs, "doc_id", "text", "lang", train_docs=None)
    counts = {lang: language.gram_counts(" ".join(t for _, t, g in rows if g == lang), language._Grams()) for lang in words}
    want = language.Profiles({lang: language.ranked(c) for lang, c in counts.items()})
    assert whole.row.keys() == want.row.keys() and all((whole.ranks[whole.row[g]] == want.ranks[want.row[g]]).all() for g in want.row)

    def sampled(*args):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(language, "_sample", sampled)
    assert language.keep_identified(docs).count() == len(rows)
