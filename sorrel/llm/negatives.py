"""Hard negatives by exact integer scores from products of residues.

Vectors of whole numbers are multiplied modulo several small primes. Residues lie between
-(p-1)/2 and (p-1)/2, so a float32 product over ``SPAN`` components stays below 2^24 and is
exact; wider vectors are multiplied span by span and reduced between. Mixed-radix digits
(Chinese remaindering) then give back the signed score, exact while the product of the primes
exceeds twice the largest score that the data allow, which is computed from all rows first.

Anchors come in blocks of at most ``ANCHOR_NUMBERS`` numbers; a block is sent to every task and
the rows are scanned where they lie, so no row is shuffled or copied for an anchor. A first scan
finds each anchor's positives, a second the best rows within each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sorrel.session import cut, exists, scratch_path

#: Components multiplied between two reductions: 64 * 510^2 + 1021 is below 2^24.
SPAN, LARGEST_PRIME = 64, 1021
#: Numbers in a block of anchors, and scores held at a time.
ANCHOR_NUMBERS, CELLS = 1 << 20, 1 << 21
#: Scores must stay below this, so that a hundred times a score is a long.
SCORE_LIMIT = 1 << 55
_NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """Largest primes up to ``LARGEST_PRIME`` whose product exceeds twice ``bound``."""
    found, product, p = [], 1, LARGEST_PRIME
    while product <= 2 * bound + 1:
        while any(p % d == 0 for d in range(2, int(p ** 0.5) + 1)):
            p -= 1
        found.append(p)
        product *= p
        p -= 1
    return found


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Rows modulo each prime, nearest to zero, in float32."""
    out = []
    for p in primes:
        r = rows % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    return x - np.float32(p) * np.rint(x / np.float32(p))


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (left rows x right rows) as int64."""
    total, radix, digits = None, 1, []
    for a, b, p in zip(left, right, primes):
        r = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, a.shape[1], SPAN):
            r = _reduced(r + _reduced(a[:, lo:lo + SPAN] @ b[:, lo:lo + SPAN].T, p), p)
        # the digit of this prime: what the digits before leave over, divided by their radices
        for d, q in digits:
            r = _reduced(_reduced(r - d, p) * np.float32(pow(q, -1, p)), p)
        r = np.where(r > p // 2, r - p, np.where(r < -(p // 2), r + p, r))
        digits.append((r, p))
        part = r.astype(np.int64) * radix
        total = part if total is None else total + part
        radix *= p
    return total


def _first(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, column, score) of the k largest entries of every line, ties by column; overwrites ``s``."""
    at, cols, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lines = np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        c = s.argmax(axis=1)
        b = s[lines, c]
        ok = b > _NONE
        if not ok.any():
            break
        at.append(lines[ok])
        cols.append(c[ok])
        best.append(b[ok])
        s[lines, c] = _NONE
    return np.concatenate(at), np.concatenate(cols), np.concatenate(best)


class _Best:
    """The k best (score, id) of every key so far."""

    def __init__(self, k: int):
        self.k = k
        self.key, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        key, ident, score = np.concatenate([self.key, key]), np.concatenate([self.id, ident]), np.concatenate([self.score, score])
        by = np.lexsort((ident, -score, key))
        key, ident, score = key[by], ident[by], score[by]
        keep = np.arange(len(key)) - np.searchsorted(key, key) < self.k
        self.key, self.id, self.score = key[keep], ident[keep], score[keep]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _scan(rows: DataFrame, block: dict, primes: list[int], width: int, k: int, choose: Callable) -> DataFrame:
    """(key, id, score): the k best rows of every key that ``choose`` makes of a chunk of scores."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        left, best = residues(own["vec"], primes), _Best(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by("id")
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            right = residues(_matrix(batch.column(2), width), primes)
            step = max(1, CELLS // len(ids))
            for lo in range(0, len(own["id"]), step):
                part = slice(lo, lo + step)
                s = scores([a[part] for a in left], right, primes)
                same = own["label"][part, None] == labels[None, :]
                other = own["id"][part, None] != ids[None, :]
                for key, (line, col, score) in choose(own, part, s, same, other):
                    best.add(key(line + lo), ids[col], score)
        yield pa.record_batch([pa.array(best.key), pa.array(best.id), pa.array(best.score)], ["key", "id", "score"])

    top = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "id"))
    found = rows.mapInArrow(run, "key long, id long, score long")
    return found.withColumn("place", top).where(F.col("place") <= k)


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, vec) of the rows that take part, components as floor(scale * x)."""
    vec = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine))
    return kept.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale)))))


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor_numbers: int = ANCHOR_NUMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    An anchor's positives are its best ``positives`` rows of the same label; for each of them come
    the best ``negatives`` rows of another label with low * positive <= 100 * negative <= high *
    positive. Scores are exact inner products of floor(scale * x); ties go to the smaller id.

    Rows with a null id, label, vector or component, or a component that is not finite, take no
    part. A row never meets rows of its own id; rows that repeat an id are anchors and candidates
    each. Vectors of different lengths, and components so large that scores leave ``SCORE_LIMIT``,
    are errors. An empty side gives no row. Other columns play no part.
    """
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base, asks = usable(rows, id_col, vec_col, label_col, scale), usable(anchors, id_col, vec_col, label_col, scale)
    base = cut(base)
    peak = F.max(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    size = lambda df: df.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec")), peak).first()
    (n, least, width, most), (n_asks, least_a, width_a, most_a) = size(base), size(asks)
    if not n or not n_asks:
        return spark.createDataFrame([], out)
    if len({least, width, least_a, width_a}) > 1:
        raise ValueError("vectors of different lengths")
    if width * most * most_a >= SCORE_LIMIT:
        raise ValueError(f"components up to {max(most, most_a)} allow scores beyond {SCORE_LIMIT}")
    primes = primes_for(width * int(most) * int(most_a))

    # blocks of about anchor_numbers numbers, also where rows repeat one id
    blocks = -(-n_asks * max(1, width) // anchor_numbers)
    path, results = scratch_path(spark, "anchors"), scratch_path(spark, "negatives")
    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    asks.withColumn("block", block).write.partitionBy("block").parquet(path)
    asked = spark.read.parquet(path)
    for number in range(blocks):
        table = asked.where(F.col("block") == number).select("id", "label", "vec").toArrow()
        if not table.num_rows:
            continue
        own = {"id": table.column(0).to_numpy(), "label": table.column(1).to_numpy(), "vec": _matrix(table.column(2).combine_chunks(), width)}

        def of_same_label(own, part, s, same, other):
            yield lambda at: at, _first(np.where(same & other, s, _NONE), positives)

        pos = _scan(base, own, primes, width, positives, of_same_label).toArrow()
        at, place = pos.column("key").to_numpy(), pos.column("place").to_numpy() - 1
        own["pos"] = np.full((table.num_rows, positives), _NONE)
        own["pos"][at, place] = pos.column("score").to_numpy()
        own["pos_id"] = np.zeros((table.num_rows, positives), np.int64)
        own["pos_id"][at, place] = pos.column("id").to_numpy()

        def in_windows(own, part, s, same, other):
            apart = ~same & other
            for j in range(positives):
                top = own["pos"][part, j]
                asked_for = top > _NONE
                top = np.where(asked_for, top, 0)[:, None]
                inside = apart & asked_for[:, None] & (100 * s <= high * top) & (100 * s >= low * top)
                yield lambda at, j=j: at * positives + j, _first(np.where(inside, s, _NONE), negatives)

        found = _scan(base, own, primes, width, negatives, in_windows)
        anchor = spark.createDataFrame(pa.table({
            "key": pa.array(np.arange(own["pos"].size)), "anchor_id": pa.array(np.repeat(own["id"], positives)),
            "positive_id": pa.array(own["pos_id"].ravel()), "positive_score": pa.array(own["pos"].ravel())}))
        found.join(anchor, "key").select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(results)
    return spark.read.schema(out).parquet(results) if exists(spark, results) else spark.createDataFrame([], out)
