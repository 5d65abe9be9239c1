"""Ranked lexical search by bit-sliced Bloom signatures, with exact scores for all that they cannot rule out.

Documents are gathered to packets of like length. A packet is a matrix of bits with a line for
each signature position and a column for each document; a term sets ``HASHES`` lines of its
document's column, once more for every power of two that its count reaches. The AND of a term's
lines is a row of documents that overestimates where the term occurs (that often).

For an item the rows of its terms are added up with the terms' weights, one sum a level of
counts; times the largest share that the level and the document's length allow, the sums bound
every document's score from above. Documents are then scored exactly from their words in order
of their bounds, until no bound reaches the lowest of the best scores so far. Whatever is left is
proven to score lower, ties included.

Items come in blocks of bounded size that every task gets; documents are read where they lie,
and a task sends on only its best for each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.common import id_text
from sorrel.session import cut, exists, scratch_path

#: Signature lines that a term sets, lines for each (term, level) of the longest document at least, and levels of counts.
HASHES, LINES_A_TERM, LEVELS = 3, 8, 8
#: Documents, bits and text bytes of a packet.
PACKET_DOCS, PACKET_BITS, PACKET_BYTES = 1024, 1 << 23, 1 << 22
#: Items of a block, and bytes of their texts (an item of more is a block of its own).
BLOCK_ITEMS, BLOCK_BYTES = 256, 1 << 19
#: Hashes of terms remembered by a task.
REMEMBERED = 1 << 18

#: Separators become spaces and A to Z become small; bytes from 128 on belong to letters.
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return raw.translate(_FOLD).split()


def _raw(batch: pa.RecordBatch) -> Iterator[bytes]:
    """UTF-8 of the texts one at a time; null is empty."""
    for value in batch.column(1):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _rows(hashes: np.ndarray, level: int, lines: int) -> np.ndarray:
    """(HASHES, n) signature lines of the terms at a level; ``lines`` is a power of two."""
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(40)) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) & np.uint64(lines - 1) for i in range(HASHES)]).astype(np.int64)


class Packet:
    """Documents of like length and their signatures."""

    def __init__(self, lines: int):
        self.lines, self.ids, self.texts, self.sizes, self.bytes = lines, [], [], [], 0
        self._hashes: list[np.ndarray] = []
        self._levels: list[np.ndarray] = []

    def add(self, ident, raw: bytes, n: int, hashes: np.ndarray, levels: np.ndarray) -> None:
        self.ids.append(ident)
        self.texts.append(raw)
        self.sizes.append(n)
        self._hashes.append(hashes)
        self._levels.append(levels)
        self.bytes += len(raw)

    def full(self) -> bool:
        return len(self.ids) >= min(PACKET_DOCS, max(1, PACKET_BITS // self.lines)) or self.bytes >= PACKET_BYTES

    def slices(self) -> np.ndarray:
        """(lines, documents / 8) bits of the signatures."""
        bits = np.zeros((self.lines, len(self.ids)), bool)
        doc = np.repeat(np.arange(len(self.ids)), [len(h) for h in self._hashes])
        hashes, levels = np.concatenate(self._hashes), np.concatenate(self._levels)
        for level in range(int(levels.max(initial=0)) + 1):
            there = levels >= level
            bits[_rows(hashes[there], level, self.lines), doc[there]] = True
        return np.packbits(bits, axis=1)


class Block:
    """Some items: their distinct terms, and for each item the terms, their weights times repeats."""

    def __init__(self, items: list[tuple[int, bytes]], n_docs: int, total: int, df: dict[bytes, int], k: int):
        self.n_docs, self.total, self.k = n_docs, total, k
        self.keys = [key for key, _ in items]
        counted = [Counter(words(raw)) for _, raw in items]
        self.terms = sorted({t for c in counted for t in c})
        at = {t: i for i, t in enumerate(self.terms)}
        weights = {t: weight(n_docs, df.get(t, 0)) for t in self.terms}
        self.scored = [[(t, weights[t] * n) for t, n in c.items()] for c in counted]
        self.places = [np.array([at[t] for t, _ in c], np.int64) for c in self.scored]
        self.weights = [np.array([w for _, w in c], float) for c in self.scored]
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in self.terms), np.uint64, len(self.terms))

    def length(self, n):
        """The length of a document of ``n`` terms against the mean one, in hundredths."""
        return 25 + (75 * n * self.n_docs) // self.total

    def exact(self, item: int, tf: dict[bytes, int], n: int) -> int:
        m = self.length(n)
        return sum(w * ((1_000_000_000 * f) // (1000 * f + 8 * m)) for t, w in self.scored[item] if (f := tf.get(t)))


def bounds(block: Block, packet: Packet) -> Iterator[tuple[int, np.ndarray]]:
    """(item, upper bound of every document's score) for the items that some document may match."""
    bits, n_docs = packet.slices(), len(packet.ids)
    n = np.array(packet.sizes, np.int64)
    m = block.length(n)
    present, share = [], []
    for level in range(LEVELS):
        lines = _rows(block.hashes, level, packet.lines)
        rows = bits[lines[0]]
        for more in lines[1:]:
            rows &= bits[more]
        if level:
            rows &= present[-1]
        if not rows.any():
            break
        present.append(rows)
        most = np.minimum(n, (2 << level) - 1) if level < LEVELS - 1 else n
        share.append((1_000_000_000 * most) // (1000 * most + 8 * m))
    some = [rows.any(axis=1) for rows in present]
    for item, (place, weights) in enumerate(zip(block.places, block.weights)):
        total = np.zeros(n_docs)
        for level, rows in enumerate(present):
            hit = some[level][place]
            if not hit.any():
                break
            own = weights[hit] @ np.unpackbits(rows[place[hit]], axis=1, count=n_docs)
            total += own * (share[level] - (share[level - 1] if level else 0))
        if total.any():
            yield item, total


class _Task:
    """The best documents of every item in one task."""

    def __init__(self, block: Block):
        self.block = block
        self.best: list[list] = [[] for _ in block.keys]
        self.packets: dict[int, Packet] = {}
        self.known: dict[bytes, int] = {}
        self.rescored = 0

    def add(self, ident, raw: bytes) -> None:
        found = Counter(words(raw))
        if not found:
            return
        counts = np.fromiter(found.values(), np.int64, len(found))
        levels = np.minimum(np.log2(counts).astype(np.int64), LEVELS - 1)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        hashes = np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t)) for t in found), np.uint64, len(found))
        lines = max(64, 1 << int(LINES_A_TERM * (levels + 1).sum() - 1).bit_length())
        packet = self.packets.setdefault(lines, Packet(lines))
        packet.add(ident, raw, int(counts.sum()), hashes, levels)
        if packet.full():
            self.rank(self.packets.pop(lines))

    def rank(self, packet: Packet) -> None:
        block, read = self.block, {}
        for item, bound in bounds(block, packet):
            best = self.best[item]
            least = lambda: max(1, best[-1][0][0] * -1) if len(best) >= block.k else 1
            open_ = np.flatnonzero(bound >= least())
            for doc in open_[np.argsort(-bound[open_], kind="stable")].tolist():
                if bound[doc] < least():
                    break
                if doc not in read:
                    read[doc] = Counter(words(packet.texts[doc]))
                score = block.exact(item, read[doc], packet.sizes[doc])
                self.rescored += 1
                if score >= least():
                    ident = packet.ids[doc]
                    best.append(((-score, ident is None, ident or 0), ident))
                    best.sort(key=lambda b: b[0])
                    del best[block.k:]

    def finish(self) -> Iterator[tuple[int, int | None, int]]:
        for lines in list(self.packets):
            self.rank(self.packets.pop(lines))
        for key, best in zip(self.block.keys, self.best):
            for (score, _, _), ident in best:
                yield key, ident, -score


def _statistics(base: DataFrame, terms: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all terms, and the documents that hold each of ``terms``."""
    sent = base.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df, n_docs, total = sent.value, Counter(), 0, 0
        for batch in batches:
            for raw in _raw(batch):
                found = words(raw)
                n_docs += bool(found)
                total += len(found)
                df.update(asked.intersection(found))
        out = [(None, n_docs, total), *((t, n, 0) for t, n in df.items())]
        yield pa.record_batch([pa.array([t for t, _, _ in out], pa.binary()), pa.array([n for _, n, _ in out], pa.int64()),
                               pa.array([m for _, _, m in out], pa.int64())], ["term", "n", "total"])

    rows = base.mapInArrow(count, "term binary, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    df = {bytes(r["term"]): r["n"] for r in rows if r["term"] is not None}
    n_docs, total = next(((r["n"], r["total"]) for r in rows if r["term"] is None), (0, 0))
    return n_docs, total, df


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ranks from 1.

    Scores and statistics are whole numbers over all documents (see the module's text for terms
    and weights). Equal scores rank by id, null ids last. Null text has no term, and an item
    without a term has no result. Rows that repeat an id are documents, or items, of their own.
    Other columns play no part; an empty side gives no row.
    """
    spark = docs.sparkSession
    out = "item_id long, rank int, doc_id long, score long"
    base = id_text(docs, id_col, text_col)
    asks = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    # blocks by a salted hash: about BLOCK_BYTES and BLOCK_ITEMS each, also where rows repeat one id
    asks = cut(asks.withColumn("key", F.monotonically_increasing_id()))
    n, size = asks.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text"))).first()
    if not n:
        return spark.createDataFrame([], out)
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    results = scratch_path(spark, "lexical")
    for number in range(blocks):
        rows = asks.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).select("key", "_text").orderBy("key").collect()
        texts = [(r["key"], r["_text"].encode()) for r in rows]
        n_docs, total, df = _statistics(base, frozenset(t for _, raw in texts for t in words(raw)))
        if not total:
            continue
        block = spark.sparkContext.broadcast(Block(texts, n_docs, total, df, k))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = _Task(block.value)
            for batch in batches:
                for ident, raw in zip(batch.column(0), _raw(batch)):
                    task.add(ident.as_py(), raw)
            got = list(task.finish())
            yield pa.record_batch([pa.array([g[i] for g in got], pa.int64()) for i in range(3)], ["key", "doc_id", "score"])

        place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        found = base.select(F.col("_id").cast("long"), "_text").mapInArrow(rank, "key long, doc_id long, score long")
        found.withColumn("rank", place).where(F.col("rank") <= k).write.mode("append").parquet(results)
    if not exists(spark, results):
        return spark.createDataFrame([], out)
    found = spark.read.schema("key long, doc_id long, score long, rank int").parquet(results)
    return found.join(asks.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
