"""Density hubs: a hierarchy of single links, condensed to clusters of a least size, the stablest ones kept.

The links are the edges of a minimum spanning tree over the distances of unit vectors, which is
what mutual reachability is when one sample (the point itself) makes a core. A group of one block gets
its tree in one task; a larger one by Boruvka rounds, each an exact search for the nearest vector of
another component, so only blocks that can hold a nearer one are visited.

The hierarchy is folded from the shortest link up. All that the links above need to know of
a part below is its size, the sum of 1 / distance at which its points joined, and the
stability of the best clusters inside. So links are folded level by level: the shortest links of a
group that fall into components of at most ``FOLD_EDGES`` links are folded in one task each
and stand for one node on the next level. Labels come back down the levels.

A cluster that meets another cluster ends; it is kept if its stability is not below that of the
kept clusters inside it. What never meets another one, the root of a group, is no cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.functions.vectors import unit
from sorrel.operators.blocks import matrix
from sorrel.operators.similarity import top_k
from sorrel.session import cut

#: Rows of a group whose tree one task finds, and links that one task folds.
TREE_ROWS, FOLD_EDGES = 2048, 50_000
#: Distances below this count as this, so that copies have a finite density.
CLOSEST = 1e-9
_LEVELS = 64


def _tree(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower id, upper id, inner product) of a maximum spanning tree, ties by ids; sums in component order."""
    n = len(ids)
    inside = np.zeros(n, bool)
    score, lo, hi = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    out, new = [], 0
    for _ in range(n - 1):
        inside[new] = True
        s = np.zeros(n)
        for j in range(m.shape[1]):
            s += m[new, j] * m[:, j]
        a, b = np.minimum(ids, ids[new]), np.maximum(ids, ids[new])
        better = ~inside & ((s > score) | (s == score) & ((a < lo) | (a == lo) & (b < hi)))
        score, lo, hi = np.where(better, s, score), np.where(better, a, lo), np.where(better, b, hi)
        open_ = np.where(inside, -np.inf, score)
        tied = np.flatnonzero((open_ == open_.max()) & ~inside)
        new = int(tied[np.lexsort((hi[tied], lo[tied]))[0]])
        out.append(new)
    return lo[out], hi[out], score[out]


def _small_trees(items: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lo, hi, score = _tree(ids[order], matrix(table, "_vec")[order])
        return pa.table([table.column("_g").take(pa.array(np.zeros(len(lo), np.int64))), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64)),
                         pa.array(score.astype(float))], ["_g", "lo", "hi", "score"])

    out = T.StructType([items.schema["_g"], T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("score", T.DoubleType())])
    return items.groupBy("_g").applyInArrow(lambda t: run(t), out)


def _large_trees(items: DataFrame, block_rows: int | None) -> list[DataFrame]:
    """The tree's links round by round: every component takes its best link, ties by ids, so links never close a ring.

    A round asks only for vectors whose last hit has come into their component and may still hold its best link.
    """
    from sorrel.operators.groups import components

    roots, found, hits = cut(items.select("_id", F.col("_id").alias("root"))), [], None
    for _ in range(_LEVELS):
        own = cut(items.join(roots, "_id"))
        live = cut(own.groupBy("_g").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where(F.col("_low") < F.col("_high")).select("_g"))
        if live.isEmpty():
            return found
        own = asks = own.join(F.broadcast(live), "_g", "left_semi")
        if hits is not None:
            # a hit outside the component is still the best; the others' scores bound what they can find now
            ends = roots.select(F.col("_id").alias("doc_id"), F.col("root").alias("_there"))
            known = hits.join(roots.select(F.col("_id").alias("query_id"), "root"), "query_id").join(ends, "doc_id").withColumn("_out", F.col("root") != F.col("_there"))
            least = known.groupBy("root").agg(F.max(F.when(F.col("_out"), F.col("score"))).alias("_least"))
            known = cut(known.join(least, "root").withColumn("_ask", ~F.col("_out") & (F.col("_least").isNull() | (F.col("score") >= F.col("_least")))))
            asks = own.join(known.where("_ask").select(F.col("query_id").alias("_id")), "_id", "left_semi")
        new = top_k(asks.withColumnRenamed("_id", "query_id"), own.withColumnRenamed("_id", "doc_id"), 1, vec="_vec", tag="root", group="_g", block_rows=block_rows).select(
            "query_id", "doc_id", "score")
        hits = cut(new if hits is None else known.where("NOT _ask").select("query_id", "doc_id", "score").unionByName(new))
        link = hits.join(own.select(F.col("_id").alias("query_id"), "_g", "root"), "query_id").join(
            roots.select(F.col("_id").alias("doc_id"), F.col("root").alias("other")), "doc_id").where(F.col("root") != F.col("other")).select(
            "_g", "root", "other", F.least("query_id", "doc_id").alias("lo"), F.greatest("query_id", "doc_id").alias("hi"), "score")
        best = F.min(F.struct((-F.col("score")).alias("away"), "lo", "hi", "other", "_g")).alias("w")
        chosen = cut(link.groupBy("root").agg(best).select("root", "w.other", "w._g", "w.lo", "w.hi", (-F.col("w.away")).alias("score")))
        if chosen.isEmpty():
            return found
        found.append(chosen.select("_g", "lo", "hi", "score").distinct())
        merged = components(chosen.select(F.col("root").alias("u"), F.col("other").alias("v"))).withColumnRenamed("root", "_to")
        roots = cut(roots.join(merged, roots["root"] == merged["node"], "left").select("_id", F.coalesce("_to", "root").alias("root")))
    raise RuntimeError("the spanning tree did not settle")


def spanning_tree(items: DataFrame, *, ident: str = "id", part: str | None = "part", vec: str = "vec", block_rows: int | None = None) -> DataFrame:
    """(_g, lo, hi, d): links of the minimum spanning tree of every group, by distance of the unit vectors.

    Rows with a NULL group or vector take no part; ids are whole numbers and not repeated.
    """
    group = F.col(part) if part else F.lit(0)
    own = cut(items.select(group.alias("_g"), F.col(ident).cast("long").alias("_id"), unit(vec).alias("_vec")).where(
        F.col("_g").isNotNull() & F.col("_vec").isNotNull()))
    sizes = own.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > (block_rows or TREE_ROWS)).select("_g"))
    tree = _small_trees(own.join(large, "_g", "left_anti"))
    if not large.isEmpty():
        for links in _large_trees(own.join(large, "_g", "left_semi"), block_rows):
            tree = tree.unionByName(links)
    return tree.select("_g", "lo", "hi", F.sqrt(F.greatest(2.0 - 2.0 * F.col("score"), F.lit(0.0))).alias("d"))


def fold(ids: np.ndarray, size: np.ndarray, joined: np.ndarray, inner: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray, least: int):
    """Fold links (u, v: places in ``ids``; d ascending) over nodes.

    A node is a part of the hierarchy: its lowest id, its points, the sum of 1 / distance at which
    its points joined the cluster it ends in, and the stability of the kept clusters inside. Gives
    for each node the lowest id of the node it ends in and its label (the outermost kept cluster that
    ended on the way, -1 without one), and the state of every node it ends in.
    """
    n = len(ids)
    over = np.full(n + len(u), -1, np.int64)
    label = np.full(n + len(u), -1, np.int64)
    head, top = list(range(n)), list(range(n))
    low, size, joined, inner = ids.tolist(), size.tolist(), joined.tolist(), inner.tolist()

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b, away in zip(u.tolist(), v.tolist(), d.tolist()):
        ra, rb = find(a), find(b)
        x, y, t = top[ra], top[rb], len(low)
        density, both = 1.0 / max(away, CLOSEST), size[x] + size[y]
        big = [z for z in (x, y) if size[z] >= least]
        if len(big) == 2:
            kept = 0.0
            for z in big:
                stability = joined[z] - size[z] * density
                if stability >= inner[z]:
                    label[z] = low[z]
                kept += max(stability, inner[z])
            joined.append(both * density)
            inner.append(kept)
        elif big:
            joined.append(joined[big[0]] + (both - size[big[0]]) * density)
            inner.append(inner[big[0]])
        else:
            joined.append(both * density if both >= least else 0.0)
            inner.append(0.0)
        low.append(min(low[x], low[y]))
        size.append(both)
        over[x] = over[y] = t
        head[rb], top[ra] = ra, t
    for t in range(len(low) - 1, -1, -1):
        if over[t] >= 0 and label[over[t]] >= 0:
            label[t] = label[over[t]]
    ends = [top[find(i)] for i in range(n)]
    pick = lambda values: np.array([values[e] for e in ends])
    return pick(low), label[:n], pick(size), pick(joined), pick(inner)


def _folded(nodes: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """(_g, node, into, label, size, joined, inner): one task folds the links of one key ``c``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.sort(left.column("node").to_numpy())
        at = np.argsort(left.column("node").to_numpy())
        size, joined, inner = (left.column(c).to_numpy()[at] for c in ("size", "joined", "inner"))
        u, v, d, lo, hi = (right.column(c).to_numpy() for c in ("u", "v", "d", "lo", "hi"))
        order = np.lexsort((hi, lo, d))
        into, label, *state = fold(ids, size, joined, inner, np.searchsorted(ids, u[order]), np.searchsorted(ids, v[order]), d[order], least)
        return pa.table([left.column("_g"), pa.array(ids), pa.array(into), pa.array(label), *map(pa.array, state)], ["_g", "node", "into", "label", "size", "joined", "inner"])

    out = T.StructType([nodes.schema["_g"], *(T.StructField(c, T.LongType()) for c in ("node", "into", "label", "size")),
                        *(T.StructField(c, T.DoubleType()) for c in ("joined", "inner"))])
    return nodes.groupBy("_g", "c").cogroup(
        links.select(F.col("_g").alias("_lg"), F.col("c").alias("_lc"), "u", "v", "d", "lo", "hi").groupBy("_lg", "_lc")).applyInArrow(lambda l, r: run(l, r), out)


def _level(links: DataFrame, fold_edges: int) -> DataFrame:
    """The links of this level with the key ``c`` of the task that folds them.

    A group of few links goes whole. Of a larger one go its shortest links, as large a share as leaves
    no component of more than ``fold_edges`` (the shortest 256th goes in any case).
    """
    from sorrel.operators.groups import components

    counts = links.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
    whole = links.join(counts.where(F.col("_k") <= fold_edges).select("_g"), "_g", "left_semi").withColumn("c", F.lit(-1).cast("long"))
    large = cut(links.join(counts.where(F.col("_k") > fold_edges).select("_g"), "_g", "left_semi"))
    if large.isEmpty():
        return cut(whole)
    share = 0.5
    while True:
        limit = large.groupBy("_g").agg(F.percentile_approx("d", share, 10_000).alias("_most"))
        short = cut(large.join(limit, "_g").where(F.col("d") <= F.col("_most")).drop("_most"))
        roots = components(short.select("u", "v")).withColumnRenamed("root", "c")
        keyed = cut(short.join(roots, short["u"] == roots["node"]).drop("node"))
        if share <= 1 / 256 or keyed.groupBy("c").count().agg(F.max("count")).first()[0] <= fold_edges:
            return cut(whole.unionByName(keyed))
        share /= 4


def density_hubs(items: DataFrame, *, ident: str = "id", part: str | None = "part", vec: str = "vec", min_size: int = 3,
                 block_rows: int | None = None, fold_edges: int = FOLD_EDGES) -> DataFrame:
    """``items`` with ``hub_id``: the lowest id of the kept cluster of ``min_size`` points at least, -1 for noise.

    Groups of ``part`` are apart. Rows with a NULL part or vector, and groups without two clusters, are noise.
    """
    links = cut(spanning_tree(items, ident=ident, part=part, vec=vec, block_rows=block_rows).withColumns({"u": F.col("lo"), "v": F.col("hi")}))
    nodes = links.select("_g", F.explode(F.array("lo", "hi")).alias("node")).distinct().select(
        "_g", "node", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("joined"), F.lit(0.0).alias("inner"))
    steps = []
    while not links.isEmpty():
        now = _level(links, fold_edges)
        at = now.select("_g", "c", F.explode(F.array("u", "v")).alias("node")).distinct()
        step = cut(_folded(nodes.join(at, ["_g", "node"]), now, min_size))
        steps.append(step)
        moved = step.select("_g", F.col("node").alias("_n"), "into")
        ended = step.where(F.col("node") == F.col("into")).select("_g", "node", "size", "joined", "inner")
        nodes = cut(nodes.join(at.select("_g", "node"), ["_g", "node"], "left_anti").unionByName(ended))
        rest = links.join(now.select("_g", "lo", "hi"), ["_g", "lo", "hi"], "left_anti")
        for end in ("u", "v"):
            rest = rest.join(moved.withColumnRenamed("_n", end).withColumnRenamed("into", "_to"), ["_g", end], "left").withColumn(
                end, F.coalesce("_to", end)).drop("_to")
        links = cut(rest)
    found = None
    for step in reversed(steps):
        own = step.select("_g", "node", "into", F.nullif(F.col("label"), F.lit(-1)).alias("label"))
        if found is None:
            found = own.select("_g", "node", "label")
        else:
            # nodes that this level left alone keep what the levels above say of them
            above = found.withColumnRenamed("node", "into").withColumnRenamed("label", "_above")
            here = own.join(above, ["_g", "into"], "left").select("_g", "node", F.coalesce("_above", "label").alias("label"))
            found = cut(found.join(own.select("_g", "node"), ["_g", "node"], "left_anti").unionByName(here))
    if found is None:
        return items.withColumn("hub_id", F.lit(-1).cast("long"))
    hubs = found.where(F.col("label").isNotNull()).select(F.col("node").alias("_node"), F.col("label").alias("hub_id"))
    return items.join(hubs, F.col(ident) == F.col("_node"), "left").drop("_node").withColumn("hub_id", F.coalesce("hub_id", F.lit(-1)).cast("long"))
