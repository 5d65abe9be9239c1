import collections

import numpy as np
import public_tokenizers
from test_language import plain_rank
from test_near_copies import stays
from test_word_passages import brute_cut
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sorrel.llm import toxicity

SF = "/root/testdata/sf0.001"


def table(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = table(docs)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "language_id", "simhash_near_dedup", "suffix_array_dedup", "packing"]

    clean = steps["toxicity"](spark, docs, SF)
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = lambda t: sum(1 / (1 + np.exp(h - sum(model.weights.get(f, 0) for f in toxicity.features(t)))) for h in model.thresholds)
    assert table(clean).keys() == {i for i, r in rows.items() if expected(r["text"]) < toxicity.REJECT}

    read = steps["language_id"](spark, docs, SF)
    assert read.columns == docs.columns and table(read) == {i: r for i, r in rows.items() if plain_rank(r["text"])}

    single = steps["simhash_near_dedup"](spark, docs, SF)
    lead = stays({i: r["text"] for i, r in rows.items()})
    assert single.columns == docs.columns and table(single) == {i: r for i, r in rows.items() if i in lead}

    cut = steps["suffix_array_dedup"](spark, docs, SF)
    want = brute_cut({i: r["text"] for i, r in rows.items()}, 400, 51)
    got = table(cut)
    assert cut.columns == docs.columns and {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and want != {i: r["text"] for i, r in rows.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = steps["packing"](spark, docs, SF).collect()
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    used = collections.Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and sum(used.values()) / (1024 * len(used)) > 0.9


def test_run_chains_the_stages(spark):
    out = __spark_entry__.queries()["pipeline"](spark, SF)
    left = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = sorted(docs.collect())
        docs = spark.createDataFrame(rows, docs.schema)
    assert left == {r["doc_id"] for r in rows}


def test_odd_rows_and_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (None, "the and of the", None, "s", 14)], docs.schema)
    some = docs.limit(20).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, some, SF)
        assert out.count() >= 15, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
