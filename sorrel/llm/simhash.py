"""SimHash near-duplicates found through fuzzy hashing with the binary Golay code.

Distinct fingerprints are cut into segments of 23, 23 and 18 bits. Among three segments that
share at most three differing bits, two differ in at most one bit each, so a pair of texts
is found if every pair of segments with one error at most in each meets.

The Golay code of length 23 is perfect: each word lies within three bits of exactly one
codeword. A word also has a few codewords at four bits (five when it is three bits off its own
codeword, none otherwise). If y differs from x in one bit at most, the codeword of y is within
four bits of x. So x offers the index of its own codeword in one segment and the six or one
nearby indices in the other, y the other way round, and both hold the same pair of indices.
The candidates of a key are verified against the full fingerprints.

Copies are grouped before any join. Keys that very many fingerprints share are cut into
blocks, and a task returns the links of a spanning forest of what it has seen, never the
pairs of a group; so components are exact and the output stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm.common import id_text, texts_of
from sorrel.llm.components import smallest_reachable
from sorrel.session import cut

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Rows of one side of a key in one block, and rows of all keys in one packet.
BLOCK, PACKET = 1024, 60_000
_KEYS_PER_TEXT = 33
_CHUNK = 1 << 16
#: Pairs compared at once: what a worker holds for them, and may keep after its stage, stays at a few MB.
PAIRS = 1 << 16

# generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_GOLAY = 0b110001110101


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of word shingles; zero without any word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1:] - 1 if len(words) >= SHINGLE else ends[-1:] - 1
    h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        part = h[lo:lo + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) per document, the fingerprint's bits as a signed long."""
    base = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t) for t in texts_of(batch)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["_id", "fp"])

    return base.mapInArrow(run, T.StructType([T.StructField("_id", base.schema["_id"].dataType), T.StructField("fp", T.LongType())]))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (_GOLAY << (bit - 11)), r)
    return r


@cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Error pattern of each syndrome, and per syndrome the patterns of four bits (none or five)."""
    unit = [1 << i for i in range(23)]
    leader = np.zeros(2048, np.int64)
    for size in (1, 2, 3):
        p = np.array([sum(unit[i] for i in c) for c in _choose(23, size)], np.int64)
        leader[_syndromes(p)] = p
    four = np.array([sum(unit[i] for i in c) for c in _choose(23, 4)], np.int64)
    s = _syndromes(four)
    order = np.argsort(s, kind="stable")
    cuts = np.searchsorted(s[order], np.arange(2049))
    # all are slices of one array: a worker keeps them
    four = four[order]
    return leader, [four[cuts[i]:cuts[i + 1]] for i in range(2048)]


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def own_index(words: np.ndarray) -> np.ndarray:
    """Index (12 information bits) of the codeword nearest to each 23-bit word."""
    leader, _ = _tables()
    return (words ^ leader[_syndromes(words)]) >> 11


@cache
def _four_table() -> tuple[np.ndarray, np.ndarray]:
    _, four = _tables()
    width = max(map(len, four))
    padded = np.zeros((2048, width), np.int64)
    for i, f in enumerate(four):
        padded[i, :len(f)] = f
    return padded, np.array([len(f) for f in four])


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index): indices of every codeword within four bits of each word."""
    padded, count = _four_table()
    s = _syndromes(words)
    n = count[s]
    at = np.repeat(np.arange(len(words)), n)
    col = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    more = (words[at] ^ padded[s[at], col]) >> 11
    return np.r_[np.arange(len(words)), at], np.r_[own_index(words), more]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, side): the keys a fingerprint offers (side 0) and looks up (side 1)."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64) for lo, width in SEGMENTS]
    own, near = [own_index(s) for s in seg], [near_indices(s) for s in seg]
    out = []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        for side, (one, many) in enumerate(((a, b), (b, a))):
            at, index = near[many]
            first, second = (own[one][at], index) if side == 0 else (index, own[one][at])
            out.append((at, (pair << 24) | (first << 12) | second, np.full(len(at), side)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        at, key, side = fuzzy_keys(fp)
        yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(side.astype(np.int8)), pa.array(fp[at])], ["k", "side", "fp"])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same numbers as the links (u, v), one fewer than each group's size."""
    ids, code = np.unique(np.r_[u, v], return_inverse=True)
    a, b = code[:len(u)], code[len(u):]
    label = np.arange(len(ids))
    while True:
        ra, rb = label[a], label[b]
        if (ra == rb).all():
            break
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _close(offered: np.ndarray, sought: np.ndarray) -> np.ndarray:
    return np.bitwise_count(offered.view(np.uint64) ^ sought.view(np.uint64)) <= MAX_BITS


def _verify_packet(table: pa.Table) -> pa.Table:
    """Links within each key of a packet, as a spanning forest of the packet's links."""
    unit, side, fp = (table.column(c).to_numpy() for c in ("unit", "side", "fp"))
    order = np.lexsort((side, unit))
    unit, side, fp = unit[order], side[order], fp[order]
    begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    end = np.r_[begin[1:], len(unit)]
    middle = begin + np.add.reduceat((side == 0).astype(np.int64), begin)
    n, m = middle - begin, end - middle
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(a, b):
        hit = _close(a, b) & (a != b)
        if hit.any():
            u, v = _forest(np.r_[us[-1], a[hit]], np.r_[vs[-1], b[hit]])
            us[-1], vs[-1] = u, v

    small = np.flatnonzero((n > 0) & (m > 0) & (n * m <= PAIRS))
    total = np.r_[0, np.cumsum(n[small] * m[small])]
    at = 0
    while at < len(small):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        g = small[at:upto]
        pairs = n[g] * m[g]
        which = np.repeat(np.arange(len(g)), pairs)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        keep(fp[begin[g][which] + inside // m[g][which]], fp[middle[g][which] + inside % m[g][which]])
        at = upto
    for g in np.flatnonzero((n > 0) & (m > 0) & (n * m > PAIRS)):
        sought = fp[middle[g]:end[g]]
        rows = max(1, PAIRS // len(sought))
        for lo in range(begin[g], middle[g], rows):
            offered = fp[lo:min(lo + rows, middle[g])]
            keep(np.repeat(offered, len(sought)), np.tile(sought, len(offered)))
    return pa.table([pa.array(us[-1]), pa.array(vs[-1])], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) links that connect exactly the fingerprints (column fp, distinct) which links of 3 bits connect."""
    rows = cut(distinct.select("fp").mapInArrow(_key_rows, "k int, side byte, fp long"))
    per_key = rows.groupBy("k").agg(F.sum(F.expr("CASE WHEN side = 0 THEN 1 ELSE 0 END")).alias("n"), F.sum("side").alias("m"))
    crowded = per_key.where((F.col("n") > BLOCK) | (F.col("m") > BLOCK)).select(
        "k", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"))
    placed = rows.join(crowded, "k", "left")
    block = lambda parts: F.pmod(F.xxhash64("fp"), F.coalesce(parts, F.lit(1))).cast("int")
    other = lambda parts: F.sequence(F.lit(0), F.greatest(F.coalesce(parts, F.lit(1)), F.lit(1)) - 1)
    offered = placed.where("side = 0").withColumn("i", block(F.col("nb"))).withColumn("j", F.explode(other(F.col("mb"))))
    sought = placed.where("side = 1").withColumn("j", block(F.col("mb"))).withColumn("i", F.explode(other(F.col("nb"))))
    units = offered.unionByName(sought).select(F.xxhash64("k", "i", "j").alias("unit"), "side", "fp")
    packets = 1 + rows.count() // PACKET
    return units.withColumn("_packet", F.pmod("unit", F.lit(packets))).groupBy("_packet").applyInArrow(
        lambda t: _verify_packet(t), "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; component_id is the smallest id reachable.

    Null text counts as having no word (fingerprint zero, linked like any other). Rows that
    repeat an id keep a row each. A row whose id is null keeps its fingerprint and takes part in
    linking; it counts for the smallest id only if it has one, so a group of null ids gets null.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    per_print = prints.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = cut(smallest_reachable(cut(links(per_print))))
    groups = per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component holds a smaller id; every column stays.

    Rows with a null id stay. Rows that repeat an id are one document and stay or go together.
    """
    found = components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == F.col("_gone"), "left_anti")
