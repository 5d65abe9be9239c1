import hashlib
import random
from collections import Counter

import pytest

from sorrel.llm import repeats


def brute(texts, threshold):
    """Spans of every text by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + threshold] for d in data for p in range(len(d) - threshold + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - threshold + 1):
            if seen[d[p:p + threshold]] > 1:
                gone[p:p + threshold] = b"\1" * threshold
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abéd") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    texts = [None, "", "a" * 90, "a" * 90, "xyz " * 30, "Thon Thon Thon Thon Thon"]
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(parts))
    return texts + texts[10:13]


@pytest.mark.parametrize("threshold,hot,segment", [(20, 128, 1 << 20), (21, 2, 64), (9, 0, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, threshold, hot, segment):
    monkeypatch.setattr(repeats, "OPEN_AS_ROWS", hot)
    monkeypatch.setattr(repeats.bundles, "__defaults__", (segment,))
    texts = corpus(threshold, 40)
    rows = [(None if i == 7 else i, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.removal_report(docs, threshold).collect()}
    want = dict(zip([r[0] for r in rows], brute(texts, threshold)))
    assert got == want


def test_rows_under_one_id_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeats.removal_report(docs, 50).collect())
    assert got == [(1, len(text)), (1, len(text)), (2, 0)]
    assert repeats.removal_report(docs.limit(0), 50).count() == 0
    kept = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs, 50).collect()}
    assert kept == {1: "", 2: "short"}


def test_removal_keeps_columns_and_valid_text(spark):
    shared = "éèê" * 20
    docs = spark.createDataFrame([(1, "é" + shared + "A", "s", None), (2, "è" + shared + "B", None, 5), (3, None, "t", 1)],
                                 "doc_id long, text string, marks string, n_chars int")
    out = repeats.remove_repeats(docs, 41)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[3]["text"] is None and rows[1]["marks"] == "s" and rows[2]["n_chars"] == 5
    assert rows[1]["text"].endswith("A") and len(rows[1]["text"]) <= 4


def test_bundles_in_a_pack_are_those_of_each_text():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé🙂") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice((1, 60, 200)))) for _ in range(40)] + [None, "", "z" * 90_000, "ab " * 40]
    for threshold, width in ((50, repeats.BYTE), (11, repeats.WORD)):
        got = {}
        for pack in repeats._packs(enumerate(texts), threshold, width):
            for k, (i, begin) in enumerate(zip(pack.text.tolist(), pack.start.tolist())):
                a, f, e = (int(x[k]) - begin for x in (pack.anchor, pack.first, pack.last))
                got.setdefault(i, []).append((a, f, e, pack.body(k)))
        for i, t in enumerate(texts):
            data = repeats.encoded(t, width)
            want = [(a, f, e, data[f * width:(e + threshold) * width]) for a, f, e in zip(*(x.tolist() for x in repeats.bundles(data, threshold, width=width)))]
            assert got.get(i, []) == want
