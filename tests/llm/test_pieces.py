import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from sorrel.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(2)
    made = [" ", "  ", "   x", "x   ", "\n", "a\n b\t", "<s></s><unk>", "<0x41>", "▁▁ a ▁b", "日本語と中文", "🙂🙃 ok", "é", "\x00\x01", "a" * 500,
            " " * 40 + "z", "\r\n", "naïve — “q”…", "ﬁ ﬂ​x", "نص عربي", "हिन्दी"]
    alphabet = "abcdeéèst  \n,.'XYZ09▁ß日🙂"
    made += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    return made + table[::3]


def test_equals_the_library(library):
    model = pieces.PieceModel(PATH)
    for text in texts():
        ids, decoded = model.encode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == want, text[:80]
        assert decoded == library.decode(want) == model.decode(want), text[:80]


def test_decodes_any_ids(library):
    rng = random.Random(4)
    model = pieces.PieceModel(PATH)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 258), rng.randint(3, 258), 3 + 0xE2, 3 + 0x96, 3 + 0x81, 29871]) for _ in range(rng.randint(0, 14))]
        assert model.decode(ids) == library.decode(ids), ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    monkeypatch.setattr(pieces, "PAIRS", 4)
    model = pieces.PieceModel(PATH)
    text = "the quick brown fox jumps over the lazy dog and the quick cat " * 3
    assert np.frombuffer(model.encode(text)[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_report_and_round_trip(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "Hello  world\n", "z"), (None, "é日", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = pieces.encode_report(docs, PATH)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = pieces.decoded(pieces.encoded(docs, PATH), PATH)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert pieces.encode_report(docs.limit(0), PATH).count() == 0
