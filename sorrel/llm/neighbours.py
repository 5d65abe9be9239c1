"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Inner products become distances by one more coordinate, the square root of M^2 - |x|^2 with M
the largest length, which is zero for a query: the nearest vector is then the one of largest
inner product. The tree is fitted on a bounded sample (``SAMPLE_ROWS``); every row is then
dropped down it to its leaf.

A query walks the tree with a priority queue: it goes down to the nearest child, queues the
other children by their distance, and resumes from the nearest queued branch, so leaves come in
order of promise. How many leaves to visit is calibrated: a bounded set of queries is answered
by brute force over all rows, and visits widen until their recall reaches ``TARGET_RECALL``.

Leaves are gathered to packets of bounded size, and a leaf that holds more (copies of one vector,
say) is cut over several; a query goes once to every packet in which it visits a leaf. A task
takes one packet and a bounded block of queries and returns their k best; scores are recomputed
in double precision in one fixed order, so ties are real ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.session import cut

#: Rows, and numbers in all, of the sample that the tree is fitted on.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 4_000_000
#: Children of a node, rows of a leaf aimed at, and rows of the sample that a leaf keeps at least.
BRANCH, LEAF_ROWS, LEAST_SAMPLE = 8, 128, 16
#: Queries answered by brute force, and the recall that their visits must reach.
CALIBRATION, TARGET_RECALL = 128, 0.95
#: Numbers in a packet of rows (16,384 rows of 64), and queries answered by one task.
PACKET_NUMBERS, QUERY_BLOCK = 1 << 20, 4096
_CHUNK = 256
_ROUNDS = 12


class Tree:
    """Nodes in one list; a node without children is a leaf with a number."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, seed: int = 7):
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self._grow(sample, max(leaf_rows, LEAST_SAMPLE))

    def _grow(self, rows: np.ndarray, leaf_rows: float) -> int:
        node = len(self.children)
        self.children.append([])
        self.centres.append(np.zeros((0, rows.shape[1])))
        self.leaf.append(-1)
        centres = self._k_means(rows) if len(rows) > leaf_rows else np.zeros((0, rows.shape[1]))
        if len(centres) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        own = _nearest(rows, centres)
        self.centres[node] = centres
        self.children[node] = [self._grow(rows[own == j], leaf_rows) for j in range(len(centres))]
        return node

    def _k_means(self, rows: np.ndarray) -> np.ndarray:
        distinct = np.unique(rows, axis=0)
        if len(distinct) <= 1:
            return distinct
        centres = distinct[self._rng.choice(len(distinct), min(BRANCH, len(distinct)), replace=False)]
        for _ in range(_ROUNDS):
            own = _nearest(rows, centres)
            centres = np.array([rows[own == j].mean(axis=0) for j in range(len(centres)) if (own == j).any()])
        own = _nearest(rows, centres)
        return centres[np.unique(own)]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row, going down to the nearest child."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            own = _nearest(rows[at], self.centres[node])
            todo += [(child, at[own == j]) for j, child in enumerate(self.children[node]) if (own == j).any()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                away = ((self.centres[node] - query) ** 2).sum(axis=1)
                best = int(np.argmin(away))
                for j, child in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(queue, (float(away[j]), child))
                node = self.children[node][best]
            yield self.leaf[node]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2.0 * (rows @ centres.T), axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) and (np.asarray(column.value_lengths()) != width).any():
        raise ValueError(f"vectors of different lengths: {width} expected")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lifted(rows: np.ndarray, scale: float, reach: float, query: bool = False) -> np.ndarray:
    """Scaled rows with the coordinate that turns inner products to distances."""
    rows = rows / scale
    more = np.zeros(len(rows)) if query else np.sqrt(np.maximum(reach ** 2 - (rows ** 2).sum(axis=1), 0.0))
    return np.c_[rows, more]


def _exact(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    total = np.zeros(len(qi))
    for j in range(q.shape[1]):
        total += q[qi, j] * c[ci, j]
    return total


def _best(q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, allowed=None):
    """(query position, row position, score): the k best allowed rows of every query, never its own."""
    qs, cs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    order = np.argsort(cid, kind="stable")
    c, cid = c[order], cid[order]
    lengths = np.sqrt((c ** 2).sum(axis=1)).max(initial=0.0)
    for lo in range(0, len(q), _CHUNK):
        part = q[lo:lo + _CHUNK]
        s = part @ c.T
        s[qid[lo:lo + _CHUNK, None] == cid[None, :]] = -np.inf
        if allowed is not None:
            s[~allowed[lo:lo + _CHUNK][:, order]] = -np.inf
        if s.shape[1] > k:
            slack = 16 * q.shape[1] * np.finfo(float).eps * lengths * np.sqrt((part ** 2).sum(axis=1))
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack
            qi, ci = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        else:
            qi, ci = np.nonzero(s > -np.inf)
        score = _exact(part, c, qi, ci)
        by = np.lexsort((ci, -score, qi))
        qi, ci, score = qi[by], ci[by], score[by]
        begin = np.searchsorted(qi, qi)
        top = np.arange(len(qi)) - begin < k
        qs.append(qi[top] + lo)
        cs.append(order[ci[top]])
        ss.append(score[top])
    return np.concatenate(qs), np.concatenate(cs), np.concatenate(ss)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) with double components, without the vectors that take no part."""
    vec = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))


def search(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
           target_recall: float = TARGET_RECALL, packet: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``corpus`` of largest inner product found for each query.

    Ranks start from 1, ties go to the smaller id. A query never finds rows of its own id, and
    gets all candidates where there are fewer than k. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids; rows that repeat an id are candidates each.
    Vectors of different lengths are an error. An empty side gives no row.
    """
    spark = corpus.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, asks = usable(corpus, id_col, vec_col), usable(queries, id_col, vec_col)
    largest = F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))
    n, width, scale = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), largest).first()
    if not n:
        return spark.createDataFrame([], out)
    reach = float(rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))).first()[0]) ** 0.5
    share = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // width)) / n
    dice = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    sampled = (rows.where(dice < share) if share < 1 else rows).toArrow().sort_by("id")
    sample = _lifted(_matrix(sampled.column("vec"), width), scale, reach)
    tree = Tree(sample, LEAF_ROWS * min(1.0, len(sample) / n))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_lifted(_matrix(batch.column(1), width), scale, reach)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(leaf.astype(np.int32))], ["id", "vec", "leaf"])

    indexed = cut(rows.mapInArrow(drop, "id long, vec array<double>, leaf int"))
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, count in indexed.groupBy("leaf").count().collect():
        sizes[leaf] = count
    visits = _calibrated(tree, indexed, asks, k, target_recall, scale, reach, width)

    # packets: small leaves share one, a large leaf is cut over several; a task gets a packet and a block of queries
    packet = packet or max(1, PACKET_NUMBERS // width)
    blocks = 1 + asks.count() // QUERY_BLOCK
    first, parts, number, held = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, 0
    for leaf in range(tree.leaves):
        if held and held + sizes[leaf] > packet:
            number, held = number + 1, 0
        first[leaf], parts[leaf] = number, max(1, -(-int(sizes[leaf]) // packet))
        if parts[leaf] > 1:
            number += parts[leaf] - 1
        held += sizes[leaf] // parts[leaf]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, salt = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield pa.record_batch([*batch.columns[:3], pa.array(first[leaf] + salt % parts[leaf])], ["id", "vec", "leaf", "packet"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, packets, leaves = [], [], []
            for i, q in enumerate(_lifted(_matrix(batch.column(1), width), scale, reach, query=True) if batch.num_rows else ()):
                by_packet: dict[int, list[int]] = {}
                seen = 0
                for done, leaf in enumerate(tree.visits(q)):
                    if done >= visits and seen > k:
                        break
                    seen += sizes[leaf]
                    for p in range(first[leaf], first[leaf] + parts[leaf]):
                        by_packet.setdefault(p, []).append(leaf)
                at += [i] * len(by_packet)
                packets += by_packet.keys()
                leaves += by_packet.values()
            take = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(packets, pa.int64()),
                                   pa.array(leaves, pa.list_(pa.int32()))], ["qid", "qvec", "packet", "leaves"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        leaf = right.column("leaf").to_numpy()
        here, row_leaf = np.unique(leaf, return_inverse=True)
        wanted = left.column("leaves").combine_chunks()
        asked = np.zeros((left.num_rows, tree.leaves), bool)
        asked[np.repeat(np.arange(left.num_rows), np.asarray(wanted.value_lengths())), wanted.flatten().to_numpy()] = True
        allowed = asked[:, here][:, row_leaf]
        qid, cid = left.column("qid").to_numpy(), right.column("id").to_numpy()
        qi, ci, score = _best(_matrix(left.column("qvec"), width), _matrix(right.column("vec"), width), qid, cid, k, allowed)
        return pa.table([pa.array(qid[qi]), pa.array(cid[ci]), pa.array(score)], names)

    salted = indexed.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 20)))
    placed = salted.mapInArrow(place, "id long, vec array<double>, leaf int, packet long")
    sent = asks.mapInArrow(ask, "qid long, qvec array<double>, packet long, leaves array<int>")
    sent = sent.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    hits = sent.groupBy("packet", "block").cogroup(placed.groupBy("packet", "block")).applyInArrow(lambda l, r: answer(l, r), "qid long, id long, score double")
    place_in = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", place_in).where(F.col("rank") <= k).select(
        F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _calibrated(tree: Tree, indexed: DataFrame, asks: DataFrame, k: int, target: float, scale: float, reach: float, width: int) -> int:
    """Leaves to visit so that a bounded set of queries finds ``target`` of its true k nearest."""
    chosen = asks.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toArrow()
    if not chosen.num_rows:
        return tree.leaves
    q, qid = _matrix(chosen.column("vec"), width), chosen.column("id").to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            qi, ci, score = _best(q, _matrix(batch.column(1), width), qid, cid, k)
            yield pa.record_batch([pa.array(qi), pa.array(cid[ci]), pa.array(score), batch.column(2).take(pa.array(ci))], ["q", "id", "score", "leaf"])

    top = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    true = indexed.mapInArrow(brute, "q long, id long, score double, leaf int").withColumn("r", top).where(F.col("r") <= k).select("q", "leaf").collect()
    if not true:
        return tree.leaves
    rank = np.zeros((len(qid), tree.leaves), np.int64)
    for i, lifted in enumerate(_lifted(q, scale, reach, query=True)):
        rank[i, list(tree.visits(lifted))] = np.arange(tree.leaves)
    needed = np.sort([rank[r["q"], r["leaf"]] for r in true])
    return int(needed[int(np.ceil(target * len(needed))) - 1]) + 1
