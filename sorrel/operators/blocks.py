"""Blocks of vectors around pivots, and which blocks can hold a score above a bound.

Every vector belongs to its nearest pivot; the vectors of one pivot (and one group) form a block
with a radius. No score of a query q in a block exceeds q.c + |q| r, so a query is routed to the
blocks whose bound reaches the score it must beat and to no others. Pivots are fitted on a
bounded sample and only decide how much is compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.session import cut

#: Sample rows (and numbers in it) that pivots are fitted on, pivots at most, and rounds of fitting.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_PIVOTS, ROUNDS = 8192, 2_000_000, 2048, 6
#: Rows of a block at least, blocks of a side while they are below the bytes of a block at most, and queries routed together.
LEAST_ROWS, SIDE_BLOCKS, BLOCK_BYTES, ROUTED = 4096, 8, 32 << 20, 4096
_CHUNK = 512
#: Relative room for rounding in a bound.
_ROOM = 1e-9


def matrix(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """The vectors of a column as rows; unequal lengths and non-finite components are errors."""
    col = table.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, 0))
    widths = np.unique(np.asarray(col.value_lengths()))
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} to {widths[-1]} components")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise ValueError("a vector has a component that is no finite number")
    return flat.reshape(len(col), -1)


def codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integer codes for two columns over one dictionary; NULL never equals anything."""
    both = pa.chunked_array(list(a.chunks) + list(b.chunks), type=a.type).combine_chunks().dictionary_encode()
    idx = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = idx[: len(a)].copy(), idx[len(a):].copy()
    left[left < 0] = -1
    right[right < 0] = -2
    return left, right


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    squares = (centres * centres).sum(axis=1)
    for lo in range(0, len(rows), _CHUNK):
        out[lo:lo + _CHUNK] = np.argmin(squares - 2.0 * (rows[lo:lo + _CHUNK] @ centres.T), axis=1)
    return out


def sized(rows: DataFrame, block_rows: int | None) -> tuple[int, int, int, int]:
    """How many rows there are, how many the largest group has, how many groups, and how many rows a block shall have."""
    per = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_cvec")).alias("_w"))
    n, largest, groups, width = per.agg(F.sum("_n"), F.max("_n"), F.count(F.lit(1)), F.max("_w")).first()
    most = BLOCK_BYTES // (8 * max(1, width or 0))
    return n or 0, largest or 0, groups, block_rows or max(LEAST_ROWS, min(most, -(-(n or 0) // SIDE_BLOCKS)))


def fit_pivots(rows: DataFrame, vec: str, n: int, block_rows: int) -> np.ndarray:
    """Means of a bounded sample's clusters, about one for each ``block_rows`` rows."""
    width = rows.agg(F.max(F.size(vec))).first()[0]
    wanted = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // max(1, width)))
    sample = matrix(rows.where(F.rand(11) < min(1.0, wanted / n)).select(vec).toArrow(), vec)
    distinct = np.unique(sample, axis=0) if len(sample) else np.zeros((1, width))
    count = min(MOST_PIVOTS, -(-n // block_rows), len(distinct))
    centres = distinct[np.random.default_rng(3).choice(len(distinct), count, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)
        used = np.unique(own)
        centres = np.array([sample[own == j].mean(axis=0) for j in used]) if len(used) else centres
    return centres


class Blocks:
    """The rows of one side (``_g``, ``_cid``, ``_ctag``, ``_cvec``) in blocks, and what bounds their scores.

    A group of at most ``block_rows`` rows is one block without a bound (number -1).
    """

    def __init__(self, rows: DataFrame, n: int, block_rows: int, grouped: bool):
        self.spark = rows.sparkSession
        self.centres = fit_pivots(rows, "_cvec", n, block_rows)
        self._sent = self.spark.sparkContext.broadcast(self.centres)
        sent = self._sent

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            for batch in batches:
                m = matrix(batch, "_cvec")
                own = _nearest(m, centres) if len(m) else np.zeros(0, np.int64)
                away = np.sqrt(((m - centres[own]) ** 2).sum(axis=1)) if len(m) else np.zeros(0)
                yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], [*batch.schema.names, "_b", "_away"])

        placed = rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("_b", T.IntegerType()), T.StructField("_away", T.DoubleType())]))
        if grouped:
            small = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= block_rows).select("_g", F.lit(True).alias("_small"))
            placed = placed.join(small, "_g", "left").withColumn("_b", F.when(F.col("_small"), -1).otherwise(F.col("_b"))).drop("_small")
        self.rows = cut(placed)
        by_tag = self.rows.groupBy("_g", "_b", "_ctag").agg(F.count(F.lit(1)).alias("_k"), F.max("_away").alias("_away"))
        self.meta = cut(by_tag.groupBy("_g", "_b").agg(
            F.sum("_k").alias("_n"), F.max("_away").alias("_radius"), F.max_by("_ctag", "_k").alias("_mode"), F.max("_k").alias("_modes")))

    def keyed(self) -> DataFrame:
        """The rows with (group, block) as their group."""
        return self.rows.select(F.struct("_g", "_b").alias("_g"), *[c for c in self.rows.columns if c not in ("_g", "_b", "_away")])

    def route(self, queries: DataFrame, block_rows: int, choose: Callable) -> DataFrame:
        """A row of ``queries`` for each block of its group that ``choose`` picks, with (group, block) as its group.

        ``choose(bounds, left, right)`` gets a bound for every query and block and returns a mask.
        """
        sent, names = self._sent, [c for c in queries.columns if c != "_g"]

        def pick(left: pa.Table, right: pa.Table) -> pa.Table:
            at, block = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if left.num_rows and right.num_rows:
                q, b = matrix(left, "_qvec"), right.column("_b").to_numpy()
                bounds = upper_bounds(q, sent.value[np.maximum(b, 0)], right.column("_radius").to_numpy())
                bounds[:, b < 0] = np.inf
                qi, bi = np.nonzero(choose(bounds, left, right))
                at, block = [qi], [b[bi]]
            take = pa.array(np.concatenate(at))
            return pa.table([left.column(c).take(take) for c in ("_g", *names)] + [pa.array(np.concatenate(block).astype(np.int32))], ["_g", *names, "_b"])

        salts = queries.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / min(block_rows, ROUTED)).cast("int").alias("_nq"))
        left = queries.join(salts, "_g").withColumn("_qs", F.pmod(F.xxhash64("_qid"), F.col("_nq")).cast("int")).drop("_nq")
        right = self.meta.join(salts, "_g").withColumn("_ms", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq").withColumnRenamed("_g", "_mg")
        out = T.StructType([queries.schema["_g"], *(queries.schema[c] for c in names), T.StructField("_b", T.IntegerType())])
        sent_to = left.groupBy("_g", "_qs").cogroup(right.groupBy("_mg", "_ms")).applyInArrow(pick, out)
        return sent_to.select(F.struct("_g", "_b").alias("_g"), *names)

    def close_pairs(self, least: float) -> DataFrame:
        """(_g, _b1, _b2) with _b1 <= _b2: the pairs of blocks of a group that can hold a score of ``least``."""
        sent = self._sent

        def pairs(meta: pa.Table) -> pa.Table:
            b, r = meta.column("_b").to_numpy(), meta.column("_radius").to_numpy()
            c = sent.value[np.maximum(b, 0)]
            longest = np.sqrt((c * c).sum(axis=1))
            most = c @ c.T + longest[:, None] * r[None, :] + longest[None, :] * r[:, None] + r[:, None] * r[None, :]
            room = _ROOM * ((longest + r)[:, None] * (longest + r)[None, :] + abs(least))
            i, j = np.nonzero(((most + room >= least) | (b < 0)[:, None]) & (b[:, None] <= b[None, :]))
            return pa.table([meta.column("_g").take(pa.array(i)), pa.array(b[i]), pa.array(b[j])], ["_g", "_b1", "_b2"])

        out = T.StructType([self.meta.schema["_g"], T.StructField("_b1", T.IntegerType()), T.StructField("_b2", T.IntegerType())])
        return cut(self.meta.groupBy("_g").applyInArrow(lambda t: pairs(t), out))


def upper_bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(queries, blocks): no inner product with a row of the block is larger."""
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    reach = np.sqrt((centres * centres).sum(axis=1)) + radius
    return q @ centres.T + size * radius + _ROOM * size * reach + np.finfo(float).tiny


def nearest_first(k: int) -> Callable:
    """Picks a query's blocks of highest bound until they hold ``k`` rows that it may find."""
    def choose(bounds: np.ndarray, left: pa.Table, right: pa.Table) -> np.ndarray:
        n, modes = right.column("_n").to_numpy(), right.column("_modes").to_numpy()
        own, mode = codes(left.column("_qtag"), right.column("_mode"))
        out = np.zeros(bounds.shape, bool)
        for lo in range(0, len(bounds), _CHUNK):
            part = bounds[lo:lo + _CHUNK]
            open_ = n[None, :] - np.where(own[lo:lo + _CHUNK, None] == mode[None, :], modes[None, :], 0)
            order = np.argsort(-part, axis=1, kind="stable")
            held = np.take_along_axis(open_, order, axis=1)
            np.put_along_axis(out[lo:lo + _CHUNK], order, np.cumsum(held, axis=1) - held < k, axis=1)
        return out

    return choose


def reaching(score: str, seen: Callable | None = None) -> Callable:
    """Picks the blocks whose bound reaches a query's ``score`` (NULL: all), but for those that ``seen`` picks."""
    def choose(bounds: np.ndarray, left: pa.Table, right: pa.Table) -> np.ndarray:
        least = left.column(score).combine_chunks().cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        room = np.where(np.isfinite(least), _ROOM * np.abs(least), 0.0)
        out = bounds >= (least - room)[:, None]
        return out & ~seen(bounds, left, right) if seen else out

    return choose
