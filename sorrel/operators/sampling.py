"""Seeded choices without replacement, reproducible from ids alone.

Order inside a choice is the MD5 of ``seed|id``: it depends on neither partitioning nor
file order. Every choice keeps at most a fixed number of rows per group, which Spark
limits before the shuffle; the complement is an anti join, so no large group is sorted
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.operators.scan import ordered_scan


_TRIMMED_BY_SPARK = 1000


def hash_order(ident: Column | str, seed) -> Column:
    c = F.col(ident) if isinstance(ident, str) else ident
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", s.cast("string"), c.cast("string")))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key with their 1-based rank.

    Spark trims each partition to ``n`` rows per key before the shuffle for ``n`` up to 1,000;
    for a larger ``n`` the rows of a key are first trimmed in parts.
    """
    if n > _TRIMMED_BY_SPARK:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(64))
        within = Window.partitionBy(*keys, part).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= n).drop(rank)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def split_build_heldout(df: DataFrame, keys: Sequence[str], ident: str, k_build: int, seed, min_heldout: int = 1) -> DataFrame:
    """Add ``role``: build for min(k, n - reserved) ids of a key, held-out for the rest.

    An id may occur in several keys and has a role in each; rows that repeat an id within a
    key share its role and count once.
    """
    keys = list(keys)
    ids = df.select(*keys, ident).distinct()
    sizes = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    picked = first_n(ids, keys, [hash_order(ident, seed), ident], k_build)
    build = _match(picked, sizes, keys).where(F.col("rn") <= F.greatest(F.lit(0), F.col("_n") - min_heldout)).select(*keys, ident, F.lit(1).alias("_b"))
    return _match(df, build, [*keys, ident], "left").withColumn("role", F.when(F.col("_b") == 1, "build").otherwise("heldout")).drop("_b")


def _match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, NULL matching NULL."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    cond = [left[c].eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(other, cond, how).drop(*[f"_on_{c}" for c in on])


def keep_draw(df: DataFrame, keys: Sequence[str], ident: str, n: int, seed) -> DataFrame:
    """Keep ``n`` rows per key for one draw (all when fewer); callers order by position."""
    return first_n(df, keys, [hash_order(ident, seed), ident], n).drop("rn")


def random_others(queries: DataFrame, pool: DataFrame, k: int, seed, *, query_id: str = "query_id", doc_id: str = "doc_id",
                  concept: str = "concept", part: str = "part") -> DataFrame:
    """Seeded ``k`` items of other concepts and the same part per query.

    Order is the hash of (seed, item), shared by all queries of a seed, as a permutation
    of the pool is. So the first ``k`` of a query lie among the first k rows of each of
    the first few concepts: only k rows per (part, concept) are ever paired, and of
    those only the k best concept-wise survivors per part plus its runners-up.
    """
    order = hash_order(doc_id, seed)
    short = first_n(pool.select(doc_id, concept, part, order.alias("_o")), [part, concept], ["_o", doc_id], k).drop("rn")
    # 2k rows suffice per part once a concept may take at most k of them
    short = first_n(short, [part], ["_o", doc_id], 2 * k).drop("rn")
    q = queries.select(query_id, F.col(concept).alias("_qc"), part)
    pairs = q.join(short, part).where(F.col("_qc") != F.col(concept))
    return first_n(pairs, [query_id], ["_o", doc_id], k).select(query_id, doc_id, (F.col("rn") - 1).alias("rank"))


def position_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_build: int, n_test: int) -> DataFrame:
    """First ``n_build`` rows of a key are build, the next ``n_test`` are test, others dropped."""
    ranked = first_n(df, keys, list(order), n_build + n_test)
    return ranked.withColumn("role", F.when(F.col("rn") <= n_build, "build").otherwise("test"))


def last_k_heldout(df: DataFrame, keys: Sequence[str], ident: str, order: str, k: int = 1) -> DataFrame:
    """Add ``role``: the last ``k`` rows of a key by ``order`` are held out, the others editable."""
    # with repeated rows of an id, its last one decides
    ids = df.groupBy(*keys, ident).agg(F.max(order).alias(order))
    tail = first_n(ids, keys, [F.col(order).desc(), F.col(ident).desc()], k)
    return _match(df, tail.select(*keys, ident, F.lit(1).alias("_h")), [*keys, ident], "left").withColumn(
        "role", F.when(F.col("_h") == 1, "heldout").otherwise("edit")).drop("_h")


def corpus_sample(items: DataFrame, matches: DataFrame, ident: str, n_per_concept: int, n_random: int, seed) -> DataFrame:
    """Up to ``n_per_concept`` matches of each concept united with ``n_random`` rows overall."""
    slices = first_n(matches, ["concept"], [hash_order(ident, F.concat_ws("|", F.lit(str(seed)), F.col("concept"))), ident],
                     n_per_concept).select(ident)
    # the leading hex digits of the hash place an id, the whole hash breaks ties
    placed = items.select(ident).distinct().withColumn("_h", hash_order(ident, seed)).withColumn(
        "_p", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double"))
    bulk = ordered_scan(placed, [], "_p", ["_h", ident], {"_r": ("sum", F.lit(1), "upto")}).where(F.col("_r") <= n_random).select(ident)
    return slices.unionByName(bulk).distinct()
