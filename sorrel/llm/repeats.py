"""Repeated byte windows by depth-limited most-significant-digit ordering of suffixes.

A byte is repeated when some window of ``threshold`` bytes over it starts at a second place
too. Ordering every suffix through ``threshold`` bytes would find all of them, at a row per
byte. Here suffixes go through the same radix passes in bundles:

1. Every window is represented by the smallest hashed half-window inside it (leftmost on
   ties), its anchor. That choice depends on the window's own bytes only, so equal windows
   have equal anchors at equal offsets, and neighbouring windows mostly share one: about one
   row per 100 bytes. The first digit is the anchor's bytes; groups of one leave.
2. The second digit is all bytes that the windows of an anchor span. Where it occurs twice,
   every window of the bundle is repeated.
3. Only bundles that agree on the first digit and differ on the second (around the edges of
   a repeated passage) are opened: their windows are ordered digit by digit to the full
   depth, groups of one leaving after each pass. What remains grouped is repeated.

Passes 1 and 2 are grouped counts with partial sums. Pass 3 runs in small packets; an anchor
with very many differing surroundings is opened into rows instead and counted the same way,
so no task ever holds a whole hot group. Digits are compared by 64-bit hashes.

The unit of depth is the byte (``width`` 1) or the word (``width`` 8): then a text is the
sequence of its words' 64-bit hashes, windows start at words and their length counts words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm.common import sliced, texts_of
from sorrel.session import cut, drop_tables

#: Surroundings of one anchor (about 500 bytes each) above which its windows are counted as rows
#: instead of in a packet: a megabyte of them.
OPEN_AS_ROWS = 2000
#: Anchor rows of the corpus per packet of pass 3 (a few in a hundred of them get there).
ROWS_PER_PACKET = 20_000
#: Window starts handled at once, so a text of any length needs bounded memory.
SEGMENT = 1 << 20
#: Units of texts whose windows are hashed together, at most ``SEGMENT``; a longer text is a pack of its own.
PACK = 1 << 16

_POSITION_BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_digest = xxhash.xxh64_intdigest
BYTE, WORD = 1, 8
_SPACED = re.compile(r"\S+")


def encoded(text: str | None, width: int = BYTE) -> bytes:
    """The text's bytes, or eight bytes for each of its words."""
    if width == BYTE:
        return (text or "").encode()
    # hashing a word costs less than remembering it
    return b"".join(map(xxhash.xxh64_digest, (text or "").split()))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, ``n`` at least."""
    size = max(1 << max(12, (n - 1).bit_length()), *_powers, 0)
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def _anchors(a: np.ndarray, threshold: int) -> np.ndarray:
    """For each window start in a run of units, where the smallest hashed half-window of its window lies."""
    half = threshold // 2
    span = threshold - half + 1
    m = len(a) - threshold + 1
    up, down = _power_tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * up[:len(a)], out=sums[1:])
    h = (sums[half:] - sums[:-half]) * down[:len(a) - half + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    h = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # sliding minimum: suffix minima of one block joined with prefix minima of the next
    blocks = np.concatenate([h, np.full(-len(h) % span, ~np.uint64(0))]).reshape(-1, span)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    right = np.minimum.accumulate(blocks, axis=1).ravel()[span - 1:span - 1 + m]
    return (np.minimum(left, right) & low).astype(np.int64)


def bundles(data: bytes, threshold: int, segment: int = SEGMENT, *, width: int = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each run of window starts first..last whose windows share an anchor."""
    starts = len(data) // width - threshold + 1
    out = []
    for begin in range(0, max(starts, 0), segment):
        m = min(segment, starts - begin)
        anchor = _anchors(np.frombuffer(data, f"u{width}", m + threshold - 1, begin * width), threshold)
        change = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.r_[0, change], np.r_[change - 1, m - 1]
        out.append((anchor[first] + begin, first + begin, last + begin))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


class _Pack:
    """Some texts behind each other and their bundles: number of the text and its first unit, anchor, first, last in the pack."""

    def __init__(self, texts: list[tuple[int, bytes]], threshold: int, width: int):
        self.threshold, self.width = threshold, width
        self.data = b"".join(d for _, d in texts) if len(texts) > 1 else texts[0][1]
        sizes = np.array([len(d) // width for _, d in texts], np.int64)
        if len(texts) == 1:
            self.anchor, self.first, self.last = bundles(self.data, threshold, width=width)
            at = np.zeros(len(self.first), np.int64)
        else:
            # windows over the end of a text are left out; an anchor lies in its window's text, so bundles end there too
            starts = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(sizes - threshold + 1) + (sizes - threshold + 1), sizes - threshold + 1)
            starts += np.arange(len(starts))
            anchor = _anchors(np.frombuffer(self.data, f"u{width}"), threshold)[starts]
            change = np.flatnonzero(np.diff(anchor)) + 1
            first = np.r_[0, change]
            self.anchor, self.first, self.last = anchor[first], starts[first], starts[np.r_[change - 1, len(starts) - 1]]
            at = np.searchsorted(np.cumsum(sizes), self.first, "right")
        self.text = np.array([i for i, _ in texts], np.int64)[at]
        self.start = (np.cumsum(sizes) - sizes)[at]

    def first_digits(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the anchors of some bundles."""
        data, w, half = self.data, self.width, self.threshold // 2
        return np.fromiter((_digest(data[a * w:(a + half) * w]) for a in self.anchor[which].tolist()), np.uint64, len(which)).view(np.int64)

    def second_digits(self) -> np.ndarray:
        """Hash of all units a bundle spans, seeded with where its anchor lies in them."""
        data, w, threshold = self.data, self.width, self.threshold
        return np.fromiter((_digest(data[f * w:(e + threshold) * w], a - f) for a, f, e in zip(self.anchor.tolist(), self.first.tolist(), self.last.tolist())),
                           np.uint64, len(self.anchor)).view(np.int64)

    def body(self, k: int) -> bytes:
        return self.data[self.first[k] * self.width:(self.last[k] + self.threshold) * self.width]


def _packs(texts: Iterable[tuple[int, str | None]], threshold: int, width: int) -> Iterator[_Pack]:
    """Numbered texts in packs; texts shorter than a window are left out. Bundles depend on their own text alone."""
    held, units = [], 0
    for i, text in texts:
        data = encoded(text, width)
        n = len(data) // width
        if n < threshold:
            continue
        if held and units + n > PACK:
            yield _Pack(held, threshold, width)
            held, units = [], 0
        held.append((i, data))
        units += n
    if held:
        yield _Pack(held, threshold, width)


def _digit_rows(threshold: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, c, n = [], [], [], []
            for pack in _packs(enumerate(texts_of(batch)), threshold, width):
                second = pack.second_digits()
                order = np.lexsort((second, pack.text))
                text, digit = pack.text[order], second[order]
                new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (digit[1:] != digit[:-1])])
                h.append(pack.first_digits(order[new]))
                c.append(digit[new])
                n.append(np.diff(np.r_[new, len(order)]))
                row.append(text[new])
            if row:
                yield pa.record_batch([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(h)),
                                       pa.array(np.concatenate(c)), pa.array(np.concatenate(n).astype(np.int64))], ["_id", "h", "c", "n"])

    return run


def _surroundings(threshold: int, width: int):
    """The bytes of the bundles that pass 3 needs, each from the one document that brings it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole]):
                needed = batch.column(2)
                row, h, c, at, body = [], [], [], [], []
                wanted = {i: set(needed[i].as_py()) for i in range(batch.num_rows)}
                for pack in _packs(enumerate(texts_of(batch)), threshold, width):
                    which = []
                    for k, (i, digit) in enumerate(zip(pack.text.tolist(), pack.second_digits().tolist())):
                        if digit in wanted[i]:
                            wanted[i].remove(digit)
                            which.append(k)
                            row.append(i)
                            c.append(digit)
                            body.append(pack.body(k))
                    which = np.array(which, np.int64)
                    h.append(pack.first_digits(which))
                    at.append(pack.anchor[which] - pack.first[which])
                if row:
                    yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.concatenate(h)), pa.array(c, pa.int64()),
                                           pa.array(np.concatenate(at)), pa.array(body, pa.binary())], ["_id", "h", "c", "at", "body"])

    return run


def _open_packet(threshold: int, width: int):
    """Order the windows of a packet digit by digit; groups of one leave after each pass."""
    step = max(1, threshold // 4)

    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        offsets = table.column("at").to_numpy()
        hashes = table.column("h").to_numpy()
        n = np.array([len(b) // width - threshold + 1 for b in bodies], np.int64)
        ctx = np.repeat(np.arange(len(bodies)), n)
        start = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
        group = np.zeros(len(ctx), np.int64)
        digits = [hashes[ctx], offsets[ctx] - start]
        depth = 0
        while len(ctx):
            order = np.lexsort((*digits[::-1], group))
            keys = [group[order], *(d[order] for d in digits)]
            new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
            number = np.cumsum(new) - 1
            stay = np.bincount(number)[number] > 1
            ctx, start, group = ctx[order][stay], start[order][stay], number[stay]
            if depth >= threshold:
                break
            digits = [np.fromiter((_digest(bodies[j][(s + depth) * width:(s + min(depth + step, threshold)) * width]) for j, s in zip(ctx.tolist(), start.tolist())),
                                  np.uint64, len(ctx)).view(np.int64)]
            depth += step
        order = np.lexsort((start, ctx))
        ctx, start = ctx[order], start[order]
        new = np.r_[True, (ctx[1:] != ctx[:-1]) | (start[1:] != start[:-1] + 1)] if len(ctx) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(ctx)] - 1 if len(head) else head
        take = pa.array(ctx[head], pa.int64())
        return pa.table([table.column("_id").take(take), table.column("c").take(take), pa.array(start[head], pa.int64()),
                         pa.array(start[tail], pa.int64())], ["_id", "c", "lo", "hi"])

    return run


def _open_rows(threshold: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, body) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                n = len(body) // width - threshold + 1
                w = np.fromiter((_digest(body[s * width:(s + threshold) * width]) for s in range(n)), np.uint64, n).view(np.int64)
                same = pa.array(np.full(n, i))
                yield pa.record_batch([batch.column(0).take(same), batch.column(1).take(same), batch.column(2).take(same),
                                       pa.array(at - np.arange(n)), pa.array(w), pa.array(np.arange(n))], ["_id", "h", "c", "o", "w", "lo"])

    return run


def row_key(id_col: str, text_col: str) -> Column:
    """A key of id and text: rows under one id or a null id are told apart, equal rows are marked alike."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def repeated_bundles(docs: DataFrame, threshold: int, id_col: str = "doc_id", text_col: str = "text", width: int = BYTE) -> DataFrame:
    """(_id, marks): for each document with repeated windows, array of (c, lo, hi).

    ``_id`` is ``row_key`` of the document. ``c`` names a bundle of it; windows lo..hi of the bundle
    are repeated, all of them when lo is -1. Documents without repeated windows have no row.
    """
    spark, owned = docs.sparkSession, []
    base = docs.select(row_key(id_col, text_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ident = base.schema["_id"].dataType

    def shape(*more: T.StructField) -> T.StructType:
        return T.StructType([T.StructField("_id", ident), *more])

    def longs(*names: str) -> list[T.StructField]:
        return [T.StructField(n, T.LongType()) for n in names]

    rows = cut(base.mapInArrow(_digit_rows(threshold, width), shape(*longs("h", "c", "n"))), owned)
    packets = 1 + rows.count() // ROWS_PER_PACKET
    first = rows.groupBy("h").agg(F.sum("n").alias("total"), (F.min("c") != F.max("c")).alias("differ")).where(F.col("total") > 1)
    met = rows.join(first.select("h", "differ"), "h")
    differing = met.where("differ")
    second = cut(differing.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("_id").alias("_id")), owned)
    whole = met.where(~F.col("differ")).select("_id", "c").unionByName(
        differing.join(second.where(F.col("n") > 1).select("h", "c"), ["h", "c"]).select("_id", "c"))

    needed = second.groupBy("_id").agg(F.collect_set("c").alias("_need")).withColumnRenamed("_id", "_rep")
    opened = base.join(needed, F.col("_id") == F.col("_rep")).select("_id", "_text", "_need").mapInArrow(
        _surroundings(threshold, width), shape(*longs("h", "c", "at"), T.StructField("body", T.BinaryType())))
    many = second.groupBy("h").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > OPEN_AS_ROWS).select("h", F.lit(True).alias("_many"))
    opened = cut(opened.join(many, "h", "left").select("_id", "h", "c", "at", "body", F.coalesce("_many", F.lit(False)).alias("_many")), owned)
    marks = shape(*longs("c", "lo", "hi"))
    packed = opened.where(~F.col("_many")).select("_id", "h", "c", "at", "body").withColumn(
        "_packet", F.pmod(F.xxhash64("h"), F.lit(packets))).groupBy("_packet").applyInArrow(_open_packet(threshold, width), marks)
    windows = opened.where("_many").select("_id", "h", "c", "at", "body").mapInArrow(
        _open_rows(threshold, width), shape(*longs("h", "c", "o", "w", "lo")))
    twice = windows.groupBy("h", "o", "w").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("h", "o", "w")
    by_row = windows.join(twice, ["h", "o", "w"]).select("_id", "c", "lo", F.col("lo").alias("hi"))
    found = whole.select("_id", "c", F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")).unionByName(packed).unionByName(by_row)
    marked = cut(found.groupBy("_id").agg(F.collect_set(F.struct("c", "lo", "hi")).alias("marks")))
    drop_tables(spark, owned)
    return marked


def _spans(texts: Iterable[tuple[int, str | None]], marks: dict[int, dict[int, list]], threshold: int, width: int) -> dict[int, list[tuple[int, int]]]:
    """Maximal runs of repeated units of numbered texts, from the marks (digit: windows) of their bundles."""
    out: dict[int, list[tuple[int, int]]] = {}
    for pack in _packs(((i, t) for i, t in texts if i in marks), threshold, width):
        for i, begin, f, e, digit in zip(pack.text.tolist(), pack.start.tolist(), pack.first.tolist(), pack.last.tolist(), pack.second_digits().tolist()):
            found = marks[i].get(digit)
            if found is None:
                continue
            spans = out.setdefault(i, [])
            f, e = f - begin, e - begin
            for lo, hi in sorted(found):
                s, t = (f, e + threshold) if lo < 0 else (f + lo, f + hi + threshold)
                if spans and s <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(spans[-1][1], t)
                else:
                    spans.append((s, t))
    return out


def _marked(column: pa.ListArray) -> dict[int, dict[int, list]]:
    """The marks of each row that has some: digit and its windows."""
    out: dict[int, dict[int, list]] = {}
    offsets, there = column.offsets.to_pylist(), column.is_valid().to_pylist()
    for i in np.flatnonzero(there).tolist():
        of = out[i] = {}
        some = slice(offsets[i], offsets[i + 1])
        for c, lo, hi in zip(*(column.values.field(k)[some].to_pylist() for k in range(3))):
            of.setdefault(c, []).append((lo, hi))
    return out


def _with_marks(docs: DataFrame, threshold: int, id_col: str, text_col: str, words: int | None) -> DataFrame:
    """(_key, _id, _text, _row, marks, _words): the marks of byte windows, and of word windows where ``words`` asks for them."""
    found = repeated_bundles(docs, threshold, id_col, text_col).select(F.col("_id").alias("_found"), "marks")
    joined = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                         F.struct(*docs.columns).alias("_row")).join(found, F.col("_key") == F.col("_found"), "left")
    if words is None:
        return joined.withColumn("_words", F.lit(None).cast("array<struct<c:bigint,lo:bigint,hi:bigint>>"))
    more = repeated_bundles(docs, words, id_col, text_col, WORD).select(F.col("_id").alias("_at"), F.col("marks").alias("_words"))
    return joined.join(more, F.col("_key") == F.col("_at"), "left")


def removal_report(docs: DataFrame, threshold: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per document, and (n_passages, passage_bytes) with ``words``.

    The last two count the maximal runs of repeated windows of so many words, whatever their bytes,
    and the bytes from their first word to their last; the first five do not depend on them.
    Null text counts as empty; texts below ``threshold`` bytes are never touched. Repeated rows
    count as places of their own, also under one id or a null id. An empty table gives an empty
    result.
    """
    joined = _with_marks(docs, threshold, id_col, text_col, words).select("_id", "_text", "marks", "_words")

    def run(batches):
        for batch in sliced(batches):
            n, removed, spans, sha, passages, passage_bytes = [], [], [], [], [], []
            by_byte = _spans(enumerate(texts_of(batch)), _marked(batch.column(2)), threshold, BYTE)
            by_word = _spans(enumerate(texts_of(batch)), _marked(batch.column(3)), words, WORD) if words else {}
            for i, text in enumerate(texts_of(batch)):
                data = (text or "").encode()
                cuts = by_byte.get(i, [])
                digest, at = hashlib.sha256(), 0
                for s, t in cuts:
                    digest.update(data[at:s])
                    at = t
                digest.update(data[at:])
                n.append(len(data))
                removed.append(sum(t - s for s, t in cuts))
                spans.append(len(cuts))
                sha.append(digest.hexdigest())
                found = _in_bytes(text, by_word.get(i))
                passages.append(len(found))
                passage_bytes.append(sum(t - s for s, t in found))
            columns = [*(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(sha, pa.string()), *(pa.array(c, pa.int64()) for c in (passages, passage_bytes))]
            yield pa.record_batch([batch.column(0), *columns], [id_col, *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    out = joined.mapInArrow(run, T.StructType([T.StructField(id_col, joined.schema["_id"].dataType), *(
        T.StructField(c, T.StringType() if c == "kept_sha256" else T.LongType()) for c in names)]))
    return out if words else out.drop("n_passages", "passage_bytes")


def _in_bytes(text: str, found: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Runs of words as spans of bytes, with the white space between their words."""
    if not found:
        return []
    at = [m.span() for m in _SPACED.finditer(text)]
    edges = sorted({0, *(at[s][0] for s, _ in found), *(at[t - 1][1] for _, t in found)})
    sizes = np.cumsum([0, *(len(text[a:b].encode()) for a, b in zip(edges, edges[1:]))])
    byte = dict(zip(edges, sizes.tolist()))
    return [(byte[at[s][0]], byte[at[t - 1][1]]) for s, t in found]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, t in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], t)
        else:
            out.append((s, t))
    return out


def remove_repeats(docs: DataFrame, threshold: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """The documents with repeated bytes cut from their text; every column and row stays.

    With ``words``, runs of so many words that start at a second place go too, however few bytes
    they have; words are what white space separates, and any white space between them counts as
    equal. A character of which only some bytes are repeated goes with them, so the text stays
    valid. Null text stays null.
    """
    joined = _with_marks(docs, threshold, id_col, text_col, words)
    marked = F.coalesce("marks", "_words").isNotNull()

    def kept(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, marks, runs in columns:
            out = []
            numbered = lambda: ((i, t.as_py()) for i, t in enumerate(texts))
            by_byte = _spans(numbered(), _marked(marks), threshold, BYTE)
            by_word = _spans(numbered(), _marked(runs), words, WORD) if words else {}
            for i, text in numbered():
                if text is None:
                    out.append(None)
                    continue
                data, parts, at = text.encode(), [], 0
                for s, t in _merged(by_byte.get(i, []) + _in_bytes(text, by_word.get(i))):
                    parts.append(data[at:s].decode(errors="ignore"))
                    at = t
                parts.append(data[at:].decode(errors="ignore"))
                out.append("".join(parts))
            yield pa.array(out, pa.string())

    left = F.arrow_udf(kept, "string")(F.when(marked, F.col("_text")), F.col("marks"), F.col("_words"))
    out = joined.select("_row", marked.alias("_cut"), left.alias("_kept"))
    return out.select(*[
        F.when(F.col("_cut"), F.col("_kept")).otherwise(F.col("_row")[c].cast("string")).alias(c) if c == text_col else F.col("_row")[c].alias(c)
        for c in docs.columns])
