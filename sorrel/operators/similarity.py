"""Exact vector search by blocked matrix products.

Rows of a group are hashed into blocks of bounded size; every (query block, corpus
block) pair of a group is one cogrouped Arrow task. A task emits its exact local
answer (k hits per query, a count per query, or a spanning forest), never the pairs,
so a group holding most rows only means more tasks. Filters and group restrictions
apply before blocking.

A group of more rows than one block has its side first cut around pivots (``blocks``). A query goes to its
most promising blocks, and with the score of its k-th hit there only to the blocks that can
hold a better one; a threshold search compares only the pairs of blocks that can reach the
threshold. On clustered vectors a row is thus shipped a few times however many rows there are;
where vectors have no structure nothing can be ruled out, and exact search is quadratic. Blocks
grow with the rows up to ``BLOCK_BYTES`` of vectors, so until then a row is shipped a fixed
number of times even so, and only the products are quadratic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.functions.vectors import as_vector
from sorrel.operators.blocks import Blocks, codes, matrix, nearest_first, reaching, sized
from sorrel.session import cut

#: Queries scored at once, and scores at once at most.
_CHUNK, _SCORES = 256, 1 << 22
#: Rows of a tag whose scores are looked at by their maximum first, and groups whose sizes are sent to all tasks at most.
_STRIP, _SENT_GROUPS = 32, 1 << 16


def _step(c: np.ndarray) -> int:
    return max(1, min(_CHUNK, _SCORES // max(1, len(c))))


def _slack(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Per query, a bound of how far a block product can be from the sequential sum."""
    longest = np.sqrt((c * c).sum(axis=1)).max(initial=0.0)
    return 16 * q.shape[1] * np.finfo(float).eps * longest * np.sqrt((q * q).sum(axis=1)) + np.finfo(float).tiny


def _sequential_dot(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Same order of additions as the column dot, hence the same last bit."""
    acc = np.zeros(len(qi))
    for j in range(q.shape[1]):
        acc += q[qi, j] * c[ci, j]
    return acc


def _run_rank(keys: np.ndarray) -> np.ndarray:
    """0-based position of each element among equal keys, in array order."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    start = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    pos = np.arange(len(s))
    rank = pos - np.maximum.accumulate(np.where(start, pos, 0)) if len(s) else pos
    out = np.empty(len(s), np.int64)
    out[order] = rank
    return out


def _masked_scores(q, c, qcode, ccode, lo, step):
    s = q[lo:lo + step] @ c.T
    if qcode is not None:
        s[qcode[lo:lo + step, None] == ccode[None, :]] = -np.inf
    return s


def _nearest(q, c, qcode, ccode, k, slack, step):
    """For chunks of queries (their rows, then query and corpus row of each candidate) what can be among the ``k`` best."""
    for lo in range(0, len(q), step):
        s = _masked_scores(q, c, qcode, ccode, lo, step)
        pool = s > -np.inf
        if len(c) > k:
            floor = np.partition(s, len(c) - k, axis=1)[:, len(c) - k]
            pool &= s >= (floor - slack[lo:lo + step])[:, None]
        yield np.arange(lo, lo + len(s)), *np.nonzero(pool)


def _nearest_capped(q, c, qcode, ccode, k, cap, slack, step):
    """Like ``_nearest``, for at most ``cap`` hits of a tag.

    Corpus rows lie tag by tag and are seen in strips by their best score. The cap-th best strip of a
    tag bounds the tag's hits, the k-th best tag bounds all, so few rows are candidates however many
    a tag has and however few tags there are. Of equal vectors of a tag only the first ``cap`` can be hits.
    """
    same = np.unique(np.ascontiguousarray(c).view(np.dtype((np.void, c.itemsize * c.shape[1]))).ravel(), return_inverse=True)[1]
    first = np.flatnonzero(_run_rank(same * (int(ccode.max()) + 3) + ccode + 2) < cap)
    order = first[np.argsort(ccode[first], kind="stable")]
    rows, code = c[order], ccode[order]
    tags, start, size = np.unique(code, return_index=True, return_counts=True)
    at = np.flatnonzero((np.arange(len(rows)) - np.repeat(start, size)) % _STRIP == 0)
    length, lead = np.diff(np.r_[at, len(rows)]), np.searchsorted(at, start)
    wide = [(x, x - (-n // _STRIP)) for x, n in zip(lead.tolist(), size.tolist()) if n > _STRIP * cap]
    turn, scores = np.argsort(qcode, kind="stable"), np.empty((min(step, len(q)), len(rows)))
    own, past = np.searchsorted(code, qcode, "left"), np.searchsorted(code, qcode, "right")
    for lo in range(0, len(q), step):
        asked = turn[lo:lo + step]
        s, left, a, b = scores[:len(asked)], q[asked], own[asked], past[asked]
        if (a == a[0]).all() and (b == b[0]).all():
            np.matmul(left, rows[:a[0]].T, out=s[:, :a[0]])
            np.matmul(left, rows[b[0]:].T, out=s[:, b[0]:])
            s[:, a[0]:b[0]] = -np.inf
        else:
            np.matmul(left, rows.T, out=s)
            for i in range(len(s)):
                s[i, a[i]:b[i]] = -np.inf
        top = np.maximum.reduceat(s, at, axis=1)
        floor = np.full(top.shape, -np.inf)
        for x, y in wide:
            floor[:, x:y] = np.partition(top[:, x:y], y - x - cap, axis=1)[:, y - x - cap, None]
        if len(tags) >= k:
            best = np.maximum.reduceat(top, lead, axis=1)
            np.maximum(floor, np.partition(best, len(tags) - k, axis=1)[:, len(tags) - k, None], out=floor)
        floor -= slack[asked, None]
        at_q, strip = np.nonzero((top >= floor) & (top > -np.inf))
        n = length[strip]
        qi, ci = np.repeat(at_q, n), np.arange(n.sum()) + np.repeat(at[strip] - (np.cumsum(n) - n), n)
        pool = (s[qi, ci] >= np.repeat(floor[at_q, strip], n)) & (s[qi, ci] > -np.inf)
        yield asked, qi[pool], order[ci[pool]]


def _topk_kernel(k: int, cap: int | None):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_cid")
        q, c = matrix(left, "_qvec"), matrix(right, "_cvec")
        schema = pa.schema([left.schema.field("_qid"), right.schema.field("_cid"),
                            right.schema.field("_ctag"), pa.field("_score", pa.float64())])
        if not len(q) or not len(c):
            return schema.empty_table()
        qcode, ccode = codes(left.column("_qtag"), right.column("_ctag"))
        slack, step = _slack(q, c), _step(c)
        found = _nearest(q, c, qcode, ccode, k, slack, step) if cap is None else _nearest_capped(q, c, qcode, ccode, k, cap, slack, step)
        keep_q, keep_c, keep_s = [], [], []
        for asked, qi, ci in found:
            exact = _sequential_dot(q[asked], c, qi, ci)
            order = np.lexsort((ci, -exact, qi))
            qi, ci, exact = qi[order], ci[order], exact[order]
            if cap is not None:
                within = _run_rank(qi * (int(ccode.max()) + 3) + ccode[ci]) < cap
                qi, ci, exact = qi[within], ci[within], exact[within]
            top = _run_rank(qi) < k
            keep_q.append(asked[qi[top]])
            keep_c.append(ci[top])
            keep_s.append(exact[top])
        qi, ci = np.concatenate(keep_q), np.concatenate(keep_c)
        return pa.table([left.column("_qid").take(pa.array(qi)), right.column("_cid").take(pa.array(ci)),
                         right.column("_ctag").take(pa.array(ci)), pa.array(np.concatenate(keep_s))], schema=schema)

    return kernel


def _above_kernel(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per query, how many corpus rows rank before its (score, id) mark."""
    right = right.sort_by("_cid")
    q, c = matrix(left, "_qvec"), matrix(right, "_cvec")
    schema = pa.schema([left.schema.field("_qid"), pa.field("_above", pa.int64())])
    if not len(q) or not len(c):
        return schema.empty_table()
    qcode, ccode = codes(left.column("_qtag"), right.column("_ctag"))
    mark = left.column("_mark").to_numpy()
    mark_id = left.column("_mark_id").to_numpy()
    cid = right.column("_cid").to_numpy()
    slack, step = _slack(q, c), _step(c)
    above = np.zeros(len(q), np.int64)
    for lo in range(0, len(q), step):
        s = _masked_scores(q, c, qcode, ccode, lo, step)
        m, near = mark[lo:lo + step, None], slack[lo:lo + step, None]
        above[lo:lo + step] = (s > m + near).sum(axis=1)
        qi, ci = np.nonzero(np.abs(s - m) <= near)
        exact = _sequential_dot(q[lo:lo + step], c, qi, ci)
        m_i, id_i = mark[lo + qi], mark_id[lo + qi]
        before = (exact > m_i) | ((exact == m_i) & (cid[ci] < id_i))
        np.add.at(above, lo + qi[before], 1)
    return pa.table([left.column("_qid"), pa.array(above)], schema=schema)


def _forest_kernel(threshold: float):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = matrix(left, "_qvec"), matrix(right, "_cvec")
        schema = pa.schema([pa.field("u", pa.int64()), pa.field("v", pa.int64())])
        if not len(q) or not len(c):
            return schema.empty_table()
        qid, cid = left.column("_qid").to_numpy(), right.column("_cid").to_numpy()
        ids, code = np.unique(np.concatenate([qid, cid]), return_inverse=True)
        qn, cn = code[: len(qid)], code[len(qid):]
        label, slack, step = np.arange(len(ids)), _slack(q, c), _step(c)
        for lo in range(0, len(q), step):
            s = q[lo:lo + step] @ c.T
            qi, ci = np.nonzero(s >= threshold - slack[lo:lo + step, None])
            near = s[qi, ci] <= threshold + slack[lo + qi]
            ok = ~near
            ok[near] = _sequential_dot(q[lo:lo + step], c, qi[near], ci[near]) >= threshold
            u, v = qn[lo + qi[ok]], cn[ci[ok]]
            while True:
                # hook the larger root under the smaller one, then flatten
                ru, rv = label[u], label[v]
                if (ru == rv).all():
                    break
                np.minimum.at(label, np.maximum(ru, rv), np.minimum(ru, rv))
                while (label != label[label]).any():
                    label = label[label]
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table([pa.array(ids[moved]), pa.array(ids[label[moved]])], schema=schema)

    return kernel


def _salt(df: DataFrame, ident: str, n_blocks: str):
    return F.pmod(F.xxhash64(F.col(ident)), F.col(n_blocks)).cast("int")


def _block_counts(df: DataFrame, group: str, rows: int, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))


def _cogrouped(q: DataFrame, c: DataFrame, kernel, schema, block_rows: int, few: bool) -> DataFrame:
    """Block both sides by ``_g`` and run ``kernel`` on each block pair."""
    sizes = _block_counts(q, "_g", block_rows, "_nq").join(_block_counts(c, "_g", block_rows, "_nc"), "_g")
    if few:
        sizes = F.broadcast(sizes)  # one row a group
    q = (q.join(sizes, "_g").withColumn("_qb", _salt(q, "_qid", "_nq"))
          .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1))).drop("_nq", "_nc"))
    c = (c.join(sizes, "_g").withColumn("_cb", _salt(c, "_cid", "_nc"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq", "_nc"))
    keys = ("_g", "_qb", "_cb")
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(kernel, schema)


def _side(df: DataFrame, prefix: str, ident: str, vec: str, tag: str | None, group: str | None, *more) -> DataFrame:
    tag_col = F.col(tag).cast("string") if tag else F.lit(None).cast("string")
    return df.select(
        (F.col(group) if group else F.lit(0)).alias("_g"), F.col(ident).alias(f"_{prefix}id"),
        tag_col.alias(f"_{prefix}tag"), as_vector(vec).alias(f"_{prefix}vec"), *more).where(
        F.col("_g").isNotNull() & F.col(f"_{prefix}vec").isNotNull())


def _best(hits: DataFrame, k: int, cap: int | None) -> DataFrame:
    """The k best hits of each query, at most ``cap`` of one tag, with their rank from 1."""
    best = [F.col("_score").desc(), F.col("_cid").asc()]
    if cap is not None:
        hits = hits.withColumn("_in", F.row_number().over(Window.partitionBy("_qid", "_ctag").orderBy(*best))).where(F.col("_in") <= cap).drop("_in")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy(*best))).where(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id", doc_id: str = "doc_id",
          vec: str = "vec", tag: str | None = None, cap: int | None = None, group: str | None = None,
          block_rows: int | None = None) -> DataFrame:
    """Exact top-k by inner product: (query_id, doc_id, tag?, score, rank) with rank from 0.

    ``tag`` names a column of both sides: a query never matches its own tag (pass the id
    to exclude only itself), and ``cap`` limits hits per tag. Capping per tag inside each
    block and again at the end picks exactly what a greedy capped walk over all scores
    picks. ``group`` restricts matches to equal groups. Ties go to the lower ``doc_id``.
    """
    q = _side(queries, "q", query_id, vec, tag, group)
    c = _side(corpus, "c", doc_id, vec, tag, group)
    schema = T.StructType([
        T.StructField("_qid", queries.schema[query_id].dataType), T.StructField("_cid", corpus.schema[doc_id].dataType),
        T.StructField("_ctag", T.StringType()), T.StructField("_score", T.DoubleType())])
    kernel, (n, most, groups, block_rows) = _topk_kernel(k, cap), sized(c, block_rows)
    if most <= block_rows:
        hits = _best(_cogrouped(q, c, kernel, schema, block_rows, groups <= _SENT_GROUPS), k, cap)
    else:
        q, blocks = cut(q), Blocks(c, n, block_rows, group is not None)
        rows, near = blocks.keyed(), nearest_first(k)
        first = cut(_best(_cogrouped(blocks.route(q, block_rows, near), rows, kernel, schema, block_rows, False), k, cap).drop("rank"))
        least = first.groupBy("_qid").agg(F.count(F.lit(1)).alias("_k"), F.min("_score").alias("_least")).where(F.col("_k") >= k).select("_qid", "_least")
        later = blocks.route(q.join(least, "_qid", "left"), block_rows, reaching("_least", near)).drop("_least")
        hits = _best(first.unionByName(_cogrouped(later, rows, kernel, schema, block_rows, False)), k, cap)
    cols = [F.col("_qid").alias(query_id), F.col("_cid").alias(doc_id)]
    if tag:
        cols.append(F.col("_ctag").alias("doc_tag"))
    return hits.select(*cols, F.col("_score").alias("score"), (F.col("rank") - 1).alias("rank"))


def count_above(queries: DataFrame, corpus: DataFrame, mark: str, mark_id: str, *, query_id: str = "query_id",
                doc_id: str = "doc_id", vec: str = "vec", tag: str | None = None, group: str | None = None,
                block_rows: int | None = None) -> DataFrame:
    """How many other-tag corpus rows come before a query's (mark, mark_id) in score order."""
    q = _side(queries, "q", query_id, vec, tag, group, F.col(mark).alias("_mark"), F.col(mark_id).alias("_mark_id"))
    c = _side(corpus, "c", doc_id, vec, tag, group)
    schema = T.StructType([T.StructField("_qid", queries.schema[query_id].dataType), T.StructField("_above", T.LongType())])
    n, most, groups, block_rows = sized(c, block_rows)
    if most <= block_rows:
        counts = _cogrouped(q, c, _above_kernel, schema, block_rows, groups <= _SENT_GROUPS)
    else:
        q, blocks = cut(q), Blocks(c, n, block_rows, group is not None)
        sent = blocks.route(q, block_rows, reaching("_mark"))
        none = q.join(blocks.meta.select("_g").distinct(), "_g", "left_semi").select("_qid", F.lit(0).cast("long").alias("_above"))
        counts = _cogrouped(sent, blocks.keyed(), _above_kernel, schema, block_rows, False).unionByName(none)
    return counts.groupBy(F.col("_qid").alias(query_id)).agg(F.sum("_above").alias("n_above"))


def threshold_forest(items: DataFrame, threshold: float, *, ident: str = "id", vec: str = "vec",
                     group: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Edges (u, v) that connect exactly the items whose similarity graph connects them.

    Each block pair yields a spanning forest of its edges at or above the threshold, so a
    dense cluster of m items costs O(m) rows per block pair instead of m squared.
    """
    q = _side(items, "q", ident, vec, None, group).withColumn("_qid", F.col("_qid").cast("long"))
    c = _side(items, "c", ident, vec, None, group).withColumn("_cid", F.col("_cid").cast("long"))
    n, most, groups, block_rows = sized(c, block_rows)
    if most <= block_rows:
        return _cogrouped(q, c, _forest_kernel(threshold), "u long, v long", block_rows, groups <= _SENT_GROUPS).distinct()
    blocks = Blocks(c, n, block_rows, group is not None)
    pairs, key = blocks.close_pairs(threshold), F.struct("_g", "_b1", "_b2").alias("_g")
    rows = blocks.rows.drop("_away")
    one = rows.withColumnRenamed("_b", "_b1").join(pairs, ["_g", "_b1"]).select(key, F.col("_cid").alias("_qid"), F.col("_cvec").alias("_qvec"))
    other = rows.withColumnRenamed("_b", "_b2").join(pairs, ["_g", "_b2"]).select(key, "_cid", "_cvec")
    return _cogrouped(one, other, _forest_kernel(threshold), "u long, v long", block_rows, False).distinct()
