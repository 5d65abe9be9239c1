"""SentencePiece encoding and decoding for merge-type models, exact, by backtracking.

A merge-type model joins the adjacent pair whose joined piece has the best score until none
is left. The same tokens come out of a left-to-right search: take the longest piece at the
position (Aho-Corasick), accept it if it is compatible with the token before it, else try the
next shorter piece at the position, else step back over the last token. Positions that no
accepted sequence passes are set in a bitfield and never tried again.

Two tokens are compatible if joining their characters by the model's own rule gives just
these two tokens back; the answers are remembered per pair. Pieces that their own characters
do not merge to are left out of the automaton, since no encoding contains them.

No token crosses a place where two characters meet that no piece holds side by side, so
texts are encoded between such places (before every space mark, around line ends, between a
word and a stop after it), and frequent stretches are remembered within a bound.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm.common import id_text, texts_of

SPACE = "▁"
#: Stretches remembered per worker (two generations of half as many), and pairs.
REMEMBERED, PAIRS = 300_000, 400_000
#: Longer stretches are not remembered.
_LONG = 48
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Encoder and decoder of one model file. Begin and end ids are added to every text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models without a character map are supported")
        if any(p.type in (_USER, _UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.bos, self.eos = self.pieces.index(trainer.bos_piece or "<s>"), self.pieces.index(trainer.eos_piece or "</s>")
        self.unknown = self.types.index(_UNKNOWN)
        self.unknown_text = trainer.unk_surface
        self.byte_of = {i: int(p[3:5], 16) for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _BYTE}
        self.byte_ids = {b: i for i, b in self.byte_of.items()} if trainer.byte_fallback else {}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        after_word = {p[i] for p in self.ids for i in range(1, len(p)) if p[i - 1].isalnum()}
        stops = re.escape("".join(c for c in ".,;:!?" if c not in after_word))
        word = f"{SPACE}*[^{SPACE}{alone}{stops}]++(?<=[^\\W_])(?=[{stops}])|" if stops else ""
        self._stretch = re.compile(f"{word}{SPACE}*[^{SPACE}{alone}]++|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        usable = [p for p in self.ids if self._merge(p) == [p]]
        self._automaton = ahocorasick.Automaton()
        for p in usable:
            self._automaton.add_word(p, (p, len(p) - 1))
        self._automaton.make_automaton()
        known = set(usable)
        self._shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in usable}
        self._shown = [p.replace(SPACE, " ") for p in self.pieces]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._young: dict[str, tuple[bytes, str]] = {}
        self._old: dict[str, tuple[bytes, str]] = {}

    def _merge(self, text: str) -> list[str]:
        """The model's own rule: join the best adjacent pair, leftmost on ties, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._merge(left + right) == [left, right]
        return found

    def _tokens(self, text: str) -> list[str]:
        """Pieces of a stretch; a character in no piece stands for itself."""
        # matches of one place come from short to long, so the last is the longest
        longest = {end - more: piece for end, (piece, more) in self._automaton.iter(text)}
        pairs, shorter, n = self._pairs, self._shorter, len(text)
        failed, tokens, at, last = 0, [], 0, None
        token = longest.get(0) or text[0]
        while True:
            while token is not None:
                end = at + len(token)
                if not failed >> end & 1:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits or fits is None and self._compatible(last, token):
                        break
                token = shorter.get(token)
            if token is None:
                # nothing fits here: the last token was wrong, its end leads nowhere
                failed |= 1 << at
                token = tokens.pop()
                last = tokens[-1] if tokens else None
                at -= len(token)
                token = shorter.get(token)
                continue
            tokens.append(token)
            if end == n:
                return tokens
            at, last = end, token
            token = longest.get(at) or text[at]

    def _ids_of(self, token: str) -> list[int]:
        i = self.ids.get(token)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in token.encode()] if self.byte_ids else [self.unknown]

    def _remember(self, stretch: str) -> tuple[bytes, str]:
        found = self._old.get(stretch)
        if found is None:
            ids = list(map(self.ids.get, self._tokens(stretch)))
            if None in ids:
                ids = [i for token in self._tokens(stretch) for i in self._ids_of(token)]
                found = struct.pack(f"<{len(ids)}I", *ids), self._surface(ids)
            else:
                found = struct.pack(f"<{len(ids)}I", *ids), "".join([self._shown[i] for i in ids])
        if len(stretch) <= _LONG:
            if len(self._young) >= REMEMBERED // 2:
                self._old, self._young = self._young, {}
            self._young[stretch] = found
        return found

    def _surface(self, ids) -> str:
        """Text of ids, space marks of pieces as spaces; runs of bytes are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_lenient(run))
                run.clear()
            kind = self.types[i]
            out.append("" if kind == _CONTROL else self.unknown_text if kind == _UNKNOWN else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_lenient(run))
        return "".join(out)

    def decode(self, ids) -> str:
        """Text of any ids: control ids vanish, the mark put before the text goes."""
        ids = list(ids)
        first = next((i for i in ids if self.types[i] != _CONTROL), None)
        surface = self._surface(ids)
        return surface[1:] if self.prefix and first is not None and self.types[first] == _NORMAL and surface[:1] == " " else surface

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids with begin and end as little-endian 32-bit numbers, decoded text)."""
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        if not text:
            return begin + end, ""
        young, remember = self._young.get, self._remember
        parts = []
        for stretch in self._stretch.findall(self.prefix + text.replace(" ", SPACE)):
            parts.append(young(stretch) or remember(stretch))
            young = self._young.get
        return b"".join([begin, *[p[0] for p in parts], end]), "".join([p[1] for p in parts])[len(self.prefix):]


def _lenient(run: bytearray) -> str:
    """UTF-8 text of a run of bytes, one replacement character for each byte that is not part of it."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at:at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``.

    Null text counts as empty and has the begin and end ids alone. Every row is encoded by
    itself, so repeated rows and null ids are rows like any other; an empty table gives none.
    """
    base = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in texts_of(batch):
                ids, decoded = model.encode(text or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                  [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.mapInArrow(run, T.StructType([
        T.StructField(id_col, base.schema["_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row: the general form for training input."""
    base = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            ids = [np.frombuffer(model.encode(t or "")[0], "<u4").astype(np.int32) for t in texts_of(batch)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return base.mapInArrow(run, T.StructType([T.StructField(id_col, base.schema["_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; null ids give null text."""
    base = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [None if v.as_py() is None else model.decode(v.as_py()) for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return base.mapInArrow(run, T.StructType([T.StructField(id_col, base.schema["_id"].dataType), T.StructField("text", T.StringType())]))
