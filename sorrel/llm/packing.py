"""Packing by vector bin packing with the dot-product heuristic.

An example takes part of three budgets of a sequence at once: tokens, segments and
loss-bearing tokens. A sequence is filled by the example that still fits in every budget and
has the largest dot product of its shares with what is left, so an example that is large in
the scarce budgets goes first. Examples longer than a sequence are cut into whole sequences
and a rest; only rests compete.

Texts are read once and never shuffled: the task that tokenises a document cuts it and sends
on a few numbers per piece. Pieces are dealt to packets of a bounded number of pieces by a
hash that includes the piece's start, so one huge document spreads over all packets, and each
packet is packed on its own; it leaves at most about one sequence half empty.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm.common import id_text, texts_of

#: Documents dealt to one packet.
DOCS_PER_PACKET = 2000
#: Segments of one sequence at most.
MAX_SEGMENTS = 128

# Letters, marks and signs on whose class every Unicode version agrees.
_SETTLED = re.compile("[^\\x00-˿Α-ΡΣ-ώЀ-ҁ‐-‧€]")


@lru_cache(maxsize=2)
def document_tokens(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer file at ``path``, without special tokens added.

    A byte-level vocabulary that also lies beside the file as ranks is applied by the faster
    library, which gives the same ids; texts that hold a special token's string or characters
    whose class may depend on a library's Unicode tables always take the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def exact(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if _SETTLED.search(text) or any(s in text for s in special):
            return exact(text)
        return fast.encode_to_numpy(text).astype(np.uint32)

    return ids


def _pieces(path: str, capacity: int, end_id: int, packets: int):
    """Cut documents to pieces: one row per piece with its checksum and its packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_tokens(path)
        for batch in batches:
            row, start, length, crc, total, packet = [], [], [], [], [], []
            for i, (text, deal) in enumerate(zip(texts_of(batch), batch.column(2).to_pylist())):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    packet.append((deal + k) % packets)
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, packet))],
                                  ["_id", "start", "length", "ids_crc32", "doc_tokens", "_packet"])

    return run


def pack(sizes: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, position) of each row of ``sizes`` (items x budgets) by the dot-product heuristic.

    Equal items are kept together and taken in the given order. An item that alone exceeds a
    budget gets a bin of its own.
    """
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    kind = kind.ravel()
    queue = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    taken = np.cumsum(left) - left
    share = kinds / capacity
    bins, position = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    number = 0
    alive = np.flatnonzero(left)
    while len(alive):
        room, at = capacity.astype(np.float64), 0
        while True:
            fits = alive[(kinds[alive] <= room).all(axis=1)]
            if not len(fits):
                if at:
                    break
                fits = alive[:1]
            best = fits[np.argmax(share[fits] @ (room / capacity))]
            item = queue[taken[best]]
            bins[item], position[item] = number, at
            taken[best] += 1
            left[best] -= 1
            room = room - kinds[best]
            at += 1
            if not left[best]:
                alive = alive[alive != best]
        number += 1
    return bins, position


def _pack_packet(id_col: str, capacity: np.ndarray):
    def run(key, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        length = table.column("length").to_numpy()
        sizes = np.stack([length, np.ones_like(length), table.column("loss").to_numpy()], axis=1)
        bins, position = pack(sizes, capacity)
        order = np.lexsort((position, bins))
        run_total = np.cumsum(length[order]) - length[order]
        head = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(order), np.int64)
        offset[order] = run_total - np.maximum.accumulate(np.where(head, run_total, 0))
        sequence = (key[0].as_py() << 32) + bins
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([*(table.column(c) for c in ("_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None,
                   end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``capacity`` tokens.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and
    empty texts have the end id alone. Repeated rows and null ids are documents like any other.
    Plain documents bear loss on all of their tokens, so ``max_loss`` is the capacity unless given.
    An empty table gives no row.
    """
    base = id_text(docs, id_col, text_col)
    ident = T.StructField("_id", base.schema["_id"].dataType)
    packets = 1 + docs.count() // DOCS_PER_PACKET
    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "_packet")]
    dealt = base.withColumn("_deal", F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(packets)))
    pieces = dealt.mapInArrow(_pieces(tokenizer_path, capacity, end_id, packets), T.StructType([ident, *fields]))
    return place(pieces.withColumn("loss", F.col("length")), capacity, max_segments, capacity if max_loss is None else max_loss, id_col)


def place(pieces: DataFrame, capacity: int, max_segments: int, max_loss: int, id_col: str = "doc_id") -> DataFrame:
    """Place pieces (_id, start, length, ids_crc32, doc_tokens, loss, _packet) under three limits at once."""
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([T.StructField(id_col, pieces.schema["_id"].dataType), *(T.StructField(c, T.LongType()) for c in names)])
    limits = np.array([capacity, max_segments, max_loss], np.float64)
    # a function of two arguments gets the packet's number as its key
    run = _pack_packet(id_col, limits)
    return pieces.groupBy("_packet").applyInArrow(lambda key, table: run(key, table), out)
