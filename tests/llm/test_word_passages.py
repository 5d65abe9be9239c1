import collections
import random
import re

import numpy as np

import corpus_pipeline
from sorrel.llm import repeats

SF = "/root/testdata/sf0.001"


def brute_cut(texts, size, words):
    """Bytes covered by a repeated window of ``size`` bytes or of ``words`` words go, with the white space between such words."""
    data = {i: t.encode() for i, t in texts.items()}
    at = {i: [(len(t[:m.start()].encode()), len(t[:m.end()].encode()), m[0]) for m in re.finditer(r"\S+", t)] for i, t in texts.items()}
    seen = collections.Counter(d[p:p + size] for d in data.values() for p in range(len(d) - size + 1))
    runs = collections.Counter(tuple(x[2] for x in w[p:p + words]) for w in at.values() for p in range(len(w) - words + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - size + 1):
            if seen[d[p:p + size]] > 1:
                gone[p:p + size] = True
        repeated = set()
        for p in range(len(at[i]) - words + 1):
            if runs[tuple(x[2] for x in at[i][p:p + words])] > 1:
                repeated.update(range(p, p + words))
        for p in repeated:
            gone[at[i][p][0]:at[i][p + 1 if p + 1 in repeated else p][0 if p + 1 in repeated else 1]] = True
        edges = np.flatnonzero(np.diff(np.r_[True, gone, True]))
        out[i] = "".join(d[s:e].decode(errors="ignore") for s, e in zip(edges[::2], edges[1::2]))
    return out


def stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, docs, SF)


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in stage(spark, docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute_cut({r["doc_id"]: r["text"] for r in docs.collect()}, 400, 51)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_passages_of_51_to_60_words_go(spark, monkeypatch):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdefghijklmnoprstuéß") for _ in range(dice.randint(1, 6)))
    many = lambda n: [word() for _ in range(n)]
    texts, passages = {}, {}
    for k in range(45, 61):
        passages[k] = many(k)
        for copy in range(2 + 4 * (k == 55)):
            space = "\n " if copy else " "
            texts[100 * k + copy] = " ".join(["x%d_%d" % (k, copy), *many(70)]) + " " + space.join(passages[k]) + " " + " ".join(["y%d_%d" % (k, copy), *many(70)])
    texts |= {1: "", 2: " ".join(many(51)), 3: "q" * 450 + " one", 4: "q" * 450 + " two"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    assert all(len(" ".join(p).encode()) < 400 for p in passages.values())
    for limit in (repeats.OPEN_AS_ROWS, 2):
        monkeypatch.setattr(repeats, "OPEN_AS_ROWS", limit)
        got = {r["doc_id"]: r["text"] for r in stage(spark, docs).collect()}
        assert got == brute_cut(texts, 400, 51)
        for i, t in got.items():
            if i >= 100:
                assert (" ".join(passages[i // 100]) in " ".join(t.split())) == (i // 100 <= 50)
