import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sorrel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def checked(spark, rows, capacity=64, **kw):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, start int, sequence_id string").repartition(3)
    out = packing.pack_documents(docs, PATH, capacity=capacity, **kw).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"]
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_seq


def test_pieces_cover_every_document_once(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "été", "straße", "naïve", "x1", "<|endoftext|>", "日本", "...", "\n"])
    rows = [(0, None), (1, ""), (2, "<|endoftext|>"), (3, "word " * 500)]
    rows += [(10 + i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    by_seq = checked(spark, rows)
    used = sum(r["length"] for p in by_seq.values() for r in p)
    assert used / (64 * len(by_seq)) > 0.9


def test_all_limits_hold(spark):
    by_seq = checked(spark, [(i, "a b c"[: i % 6]) for i in range(60)], max_segments=3, max_loss=9)
    assert max(map(len, by_seq.values())) <= 3
    assert max(sum(r["length"] for r in p) for p in by_seq.values()) <= 9


def test_scarce_budget_decides():
    sizes = np.array([[50, 1, 0], [50, 1, 60], [50, 1, 60], [50, 1, 0]])
    bins, _ = packing.pack(sizes, np.array([100.0, 8, 60]))
    assert bins[1] != bins[2] and len(set(bins)) == 2
    bins, _ = packing.pack(np.array([[500, 1, 1]]), np.array([100.0, 8, 60]))
    assert bins.tolist() == [0]


@pytest.mark.parametrize("text", ["plain words, it's 12 o'clock", "Ça été\t\n  x  ", "<|endoftext|> in text", "日本語 текст — “q”", "a" * 3000])
def test_ids_equal_the_tokenizer(text):
    assert packing.document_tokens(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    out = packing.pack_documents(docs, PATH, capacity=8).collect()
    assert len(out) == 3 and len({(r["sequence_id"], r["offset"]) for r in out}) == 3
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
