"""Near copies by the Jaccard similarity of five-word shingles.

SimHash within three bits finds copies that differ in a word or two of many. Texts with four
fifths of their shingles in common differ by about ten bits, which no choice of Golay segments
of 64 bits can key. They are found by an exact prefix filter instead: put the shingles of every
set in one order, rare ones first. Sets of a and b shingles are alike only if they share 4/9 (a + b)
of them; so their first common shingle stands among the first fifth of each, and the larger the
place at which it stands, the fewer shingles are left to share. A set is keyed by its first
fifth, and two sets of one key are compared only if the places allow the similarity: pages
of one template, which share half their text, mostly are not.

The smaller set of a pair must stand at a place that a set of its own size could match, so each
key has few sets that offer themselves. Its members are compared with the key's hub first, the offer
with the fewest rarer shingles: of texts edited from one base, the least edited. Only where that
leaves a key in several components do offers meet the members of other components, in blocks of
bounded size: a pair becomes a row only if places and 512 parities, which bound the difference,
allow it. A mass of near copies thus costs a comparison a member and key. Sets are shipped once to
each packet of comparisons, not once a pair.

Shingle sets are eight times as large as what a key needs and are never written down: texts are
read once for names and SimHashes, once for counters, once for keys, and those of compared sets
once more. ``docs`` should therefore be a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm import simhash
from sorrel.llm.common import id_text, sliced, texts_of
from sorrel.llm.components import smallest_reachable
from sorrel.session import cut, drop_tables

WORDS = 5
#: Similarity from which two texts are near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Bits that bound from below in how many shingles two sets differ.
PARITIES = 512
#: Counters that tell rare shingles from frequent ones (the order only decides how much is compared), and their parts.
COUNTERS, PARTS = 1 << 18, 16
#: Names of sets that a task remembers to have keyed.
REMEMBERED = 1 << 18
#: Odd factors that mix the hashes of words.
MIX = tuple(np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
#: Bytes of sets in a packet of comparisons, and comparisons of one set in a packet.
PACKET_BYTES, PACKET_PAIRS = 1 << 23, 512
#: Rows of a key's block, rows of a packet of blocks, and pairs that a packet looks at together.
BLOCK, PACKET_ROWS, CHUNK = 4096, 1 << 15, 1 << 15


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle.

    A shingle's hash mixes the hashes of its words, so every word is hashed once.
    """
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    # nothing is remembered from text to text: a worker outlives its stage and would keep it
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(WORDS, len(words))
    n = len(words) - span + 1
    mixed = np.full(n, span, np.uint64)
    for i in range(span):
        mixed = mixed * MIX[0] + each[i:i + n]
    for factor in MIX[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(33))) * factor
    return np.unique(mixed ^ (mixed >> np.uint64(33)))


def digest(found: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def parities(found: np.ndarray) -> list[int]:
    """Whether an odd number of shingles falls on each of ``PARITIES`` bits, as signed 64-bit words.

    The parities of two sets differ in no more bits than the sets differ in shingles.
    """
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of at least ``SIMILAR``."""
    if SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _signatures(base: DataFrame) -> DataFrame:
    """(_id, t, s, size, fp, odd) per text: its hash, name, size and parities of its shingle set, and its SimHash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s, size, fp, odd = [], [], [], []
            for text in texts_of(batch):
                found = shingles(text)
                s.append(digest(found))
                odd.append(parities(found))
                size.append(len(found))
                fp.append(simhash.fingerprint(text))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.int64()), pa.array(size, pa.int32()),
                                   pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(odd, pa.list_(pa.int64()))], ["_id", "t", "s", "size", "fp", "odd"])

    return base.select("_id", F.xxhash64("_text").alias("t"), "_text").mapInArrow(run, T.StructType([
        T.StructField("_id", base.schema["_id"].dataType), T.StructField("t", T.LongType()), T.StructField("s", T.LongType()),
        T.StructField("size", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("odd", T.ArrayType(T.LongType()))]))


def _frequencies(base: DataFrame) -> np.ndarray:
    """How many shingles fall on each of ``COUNTERS`` counters; its size does not grow with the texts."""
    width = COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                np.add.at(counts, (shingles(text) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield pa.record_batch([pa.array(np.arange(PARTS)), pa.array([np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for c in counts.reshape(PARTS, width)])],
                              ["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for value in batch.column(1):
                total += np.frombuffer(value.as_buffer(), np.uint32)
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()])], ["part", "counts"])

    shape = "part long, counts binary"
    out = np.zeros((PARTS, width), np.uint32)
    for part, counts in base.select("_text").mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape).collect():
        out[part] = np.frombuffer(counts, np.uint32)
    return out.ravel()


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, rare ones first, of which an alike set holds at least one."""
    n = len(found)
    keep = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1
    order = np.argsort(counts[(found & np.uint64(len(counts) - 1)).astype(np.int64)], kind="stable")
    return found[order[:keep]]


def _keys(base: DataFrame) -> DataFrame:
    """(k, s, size, at): the keys of every set with a shingle, and their places in its order.

    A task gives the keys of equal sets once, so copies add at most a row a task to a key.
    """
    sent = base.sparkSession.sparkContext.broadcast(_frequencies(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        for batch in sliced(batches):
            names, sizes, keys = [], [], []
            for text in texts_of(batch):
                found = shingles(text)
                s = digest(found)
                if s in seen or not len(found):
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(s)
                names.append(s)
                sizes.append(len(found))
                keys.append(prefix(found, counts))
            n = np.array([len(k) for k in keys], np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            k = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(k), pa.array(np.repeat(np.array(names, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int32), n)),
                                   pa.array(at.astype(np.int32))], ["k", "s", "size", "at"])

    return base.select("_text").mapInArrow(run, "k long, s long, size int, at int")


def _sets(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, body): the sorted shingles of the sets whose texts have a hash ``t`` of ``wanted``; a task gives equal sets once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches):
            names, bodies = [], []
            for text in texts_of(batch):
                found = shingles(text)
                s = digest(found)
                if s not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(s)
                    names.append(s)
                    bodies.append(found.tobytes())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], ["s", "body"])

    return base.select(F.xxhash64("_text").alias("t"), "_text").join(wanted, "t", "left_semi").select("_text").mapInArrow(run, "s long, body binary")


def _may(a: str, b: str, at_a: str, at_b: str) -> Column:
    """Whether sets of ``a`` and ``b`` shingles whose first common one stands at these places can be alike."""
    left = F.least(F.col(a) - F.col(at_a), F.col(b) - F.col(at_b))
    return left * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (F.col(a) + F.col(b))


def _near_parity(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs whose parities differ in few enough bits for alike sets."""
    odd = prints.groupBy("s").agg(F.first("odd").alias("odd"))
    both = pairs.join(odd.select(F.col("s").alias("u"), F.col("odd").alias("_a")), "u").join(odd.select(F.col("s").alias("v"), F.col("odd").alias("_b")), "v")
    apart = F.aggregate(F.zip_with("_a", "_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    most = (SIMILAR[1] - SIMILAR[0]) * (F.col("a") + F.col("b"))
    return both.where(apart * (SIMILAR[0] + SIMILAR[1]) <= most).select("u", "v", "a", "b")


def _verified(pairs: DataFrame, prints: DataFrame, base: DataFrame, owned: list[str] | None = None) -> DataFrame:
    """The pairs (u, v) whose sets are alike; ``pairs`` has their sizes a and b too. Only their texts are read again."""
    n, size = pairs.agg(F.count(F.lit(1)), F.sum(8 * F.col("b"))).first()
    if not n:
        return pairs.select("u", "v")
    packets = 1 + max(size // PACKET_BYTES, n // (64 * PACKET_PAIRS))
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PACKET_PAIRS).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    part = F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1)))
    dealt = cut(pairs.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("u", part), F.lit(packets)).cast("int").alias("packet")), owned)
    wanted = cut(dealt.select(F.col("packet").alias("_in"), F.explode(F.array("u", "v")).alias("s")).distinct(), owned)
    # a set's texts may differ in case and white space: one of them is enough
    texts = cut(prints.groupBy("s").agg(F.min("t").alias("t")).join(wanted.select("s").distinct(), "s", "left_semi").select("t").distinct(), owned)
    sets = _sets(base, texts).groupBy("s").agg(F.first("body").alias("body"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names, bodies = right.column("s").to_pylist(), right.column("body")
        own = {s: np.frombuffer(b.as_buffer(), np.uint64) for s, b in zip(names, bodies)}
        hit = [alike(own[u], own[v]) for u, v in zip(left.column("u").to_pylist(), left.column("v").to_pylist())]
        return left.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    sent = wanted.join(sets, "s").select("_in", "s", "body")
    return dealt.groupBy("packet").cogroup(sent.groupBy("_in")).applyInArrow(compare, "u long, v long")


def _meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, a, b): the pairs of a packet's blocks that places and parities allow, a chunk at a time."""
    table = pa.Table.from_batches(batches)
    unit, side = (table.column(c).to_numpy() for c in ("unit", "side"))
    order = np.lexsort((side, unit))
    unit, side = unit[order], side[order]
    s, size, at, root = (table.column(c).to_numpy()[order] for c in ("s", "size", "at", "root"))
    odd = table.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(s), -1)[order]
    begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    n = np.diff(np.r_[begin, len(unit)])
    # a block's rows that only offer come first, those that only are sought last
    sought = np.repeat(begin + np.add.reduceat((side == 0).astype(np.int64), begin), n)
    m = np.repeat(begin + n, n) - sought
    offers = np.flatnonzero((side < 2) & (m > 0))
    upto = np.cumsum(m[offers])
    lo = 0
    while lo < len(offers):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - m[offers[lo]] + CHUNK, "right")))
        each = m[offers[lo:hi]]
        i = np.repeat(offers[lo:hi], each)
        j = sought[i] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        left = np.minimum(size[i] - at[i], size[j] - at[j])
        may = (root[i] != root[j]) & (size[i] <= size[j]) & (left * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (size[i] + size[j]))
        i, j = i[may], j[may]
        apart = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
        near = apart * (SIMILAR[0] + SIMILAR[1]) <= (SIMILAR[1] - SIMILAR[0]) * (size[i] + size[j])
        i, j = i[near], j[near]
        yield pa.record_batch([pa.array(c) for c in (s[i], s[j], size[i], size[j])], ["u", "v", "a", "b"])
        lo = hi


def crossing(apart: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v, a, b): the pairs of sets under one key but of different roots that may be alike, the smaller first.

    Pairs are looked at in blocks of ``BLOCK`` rows and become rows only if places and parities
    allow them; a key of more rows is cut to blocks, each pair of which is one unit of work.
    """
    odd = prints.groupBy("s").agg(F.first("odd").alias("odd"))
    rows = apart.select("k", "s", F.col("size").cast("long").alias("size"), F.col("at").cast("long").alias("at"), "root", "offers")
    n = rows.count()
    crowded = rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    placed = rows.join(odd, "s").join(crowded, "k", "left")
    parts = F.coalesce("_parts", F.lit(1))
    own, all_ = F.pmod(F.xxhash64("s"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    # side 0 only offers, 1 does both, 2 is only sought
    whole = placed.where(F.col("_parts").isNull()).select(F.xxhash64("k").alias("unit"), F.when(F.col("offers"), 1).otherwise(2).alias("side"), "s", "size", "at", "root", "odd")
    many = placed.where(F.col("_parts").isNotNull()).withColumn("_own", own)
    offered = many.where("offers").withColumn("_other", F.explode(all_)).select(F.xxhash64("k", "_own", "_other").alias("unit"), F.lit(0).alias("side"), "s", "size", "at", "root", "odd")
    sought = many.withColumn("_other", F.explode(all_)).select(F.xxhash64("k", "_other", "_own").alias("unit"), F.lit(2).alias("side"), "s", "size", "at", "root", "odd")
    units = whole.unionByName(offered).unionByName(sought)
    return units.withColumn("_packet", F.pmod("unit", F.lit(1 + n // PACKET_ROWS))).groupBy("_packet").applyInArrow(_meet, "u long, v long, a long, b long").distinct()


def candidates(keys: DataFrame, owned: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, starred): the rows of keys that an offer shares with another set, and each such set beside the key's hub."""
    offers = (F.col("size") - F.col("at")) * (SIMILAR[0] + SIMILAR[1]) >= 2 * SIMILAR[0] * F.col("size")
    # few keys have two sets: they are found before anything else moves
    met: list[str] = []
    twice = cut(keys.groupBy("k").agg(F.min("s").alias("_lo"), F.max("s").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("k"), met)
    some = cut(keys.join(twice, "k").withColumn("offers", offers), met)
    hub = some.where("offers").groupBy("k").agg(F.min(F.struct("at", "s", "size")).alias("hub"))
    members = cut(some.join(hub, "k"), owned)
    drop_tables(keys.sparkSession, met)
    named = members.select("k", "s", F.col("size").alias("b"), F.col("at").alias("_at"), F.col("hub.s").alias("u"), F.col("hub.size").alias("a"), F.col("hub.at").alias("_hub_at"))
    starred = named.where((F.col("s") != F.col("u")) & _may("a", "b", "_hub_at", "_at")).select("u", F.col("s").alias("v"), "a", "b").distinct()
    return members.drop("hub"), starred


def set_links(prints: DataFrame, base: DataFrame) -> DataFrame:
    """(u, v) links that connect the shingle sets which similarities of ``SIMILAR`` connect."""
    spark, owned = prints.sparkSession, []
    keys: list[str] = []
    members, starred = candidates(cut(_keys(base), keys), owned)
    starred = cut(starred, owned)
    drop_tables(spark, keys)
    first = cut(_verified(cut(_near_parity(starred, prints), owned), prints, base, owned))

    roots = cut(smallest_reachable(first))
    named = members.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = named.groupBy("k").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("k")
    apart = cut(named.join(mixed, "k"), owned)
    crossed = cut(crossing(apart, prints), owned)
    fresh = crossed.join(starred.select("u", "v"), ["u", "v"], "left_anti")
    second = cut(_verified(cut(fresh, owned), prints, base, owned))
    drop_tables(spark, owned)
    return first.unionByName(second)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) per row of ``docs``; component_id is the smallest id reachable.

    Two texts are linked if their five-word shingles have a Jaccard similarity of 0.8 at least,
    or if their SimHashes differ in three bits at most. Null text counts as having no word; all
    such texts are alike. Null and repeated ids are treated as in ``simhash.components``.
    """
    base = id_text(docs, id_col, text_col)
    prints = cut(_signatures(base))
    named = prints.select("_id", "s", "fp")
    by_set = set_links(prints, base)
    for column, found in (("s", by_set), ("fp", simhash.links(named.select("fp").distinct()))):
        roots = cut(smallest_reachable(cut(found)))
        named = named.join(roots.withColumnRenamed("node", column), column, "left").withColumn(
            f"_{column}", F.xxhash64(F.lit(column), F.coalesce("root", column))).drop("root")
    named = cut(named.select("_id", "_s", "_fp"))
    joined = cut(smallest_reachable(named.select(F.col("_s").alias("u"), F.col("_fp").alias("v")).distinct()))
    named = named.join(joined, F.col("_s") == F.col("node")).select("_id", "root")
    least = named.groupBy("root").agg(F.min("_id").alias("component_id"))
    return named.join(least, "root").select(F.col("_id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component holds a smaller id; every column stays.

    Rows with a null id stay. Rows that repeat an id are one document and stay or go together.
    """
    # written first: its measured size lets Spark send it to the documents, which otherwise are shuffled
    found = cut(components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(found, docs[id_col] == F.col("_gone"), "left_anti")
