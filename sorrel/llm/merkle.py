"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions only.

Sections are separated by an empty line, paragraphs by a line end, and a paragraph's leaves are
runs of eight words with the white space before them. A leaf is the MD5 of its bytes, every
node above it the SHA-256 of its children's digests in order. Joining the parts gives the text
back, so equal roots mean equal texts; where roots differ, only branches that differ need to be
followed down to the edit. Two trees are alike by the share of distinct leaves they have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.order import range_buckets

#: Words of a leaf.
LEAF_WORDS = 8
#: Neighbouring documents brought together in one group.
ROWS_PER_BUCKET = 256

_LEAF = rf"(?:[\x09-\x0D\x20]*+[^\x09-\x0D\x20]++){{1,{LEAF_WORDS}}}+|[\x09-\x0D\x20]++"


def tree(text: Column) -> Column:
    """Leaves of a text as sections of paragraphs of digests; empty text is one empty paragraph."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda w: F.md5(w.cast("binary")))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def _node(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children).cast("binary"), 256)


def paragraphs(tree_col: Column) -> Column:
    """Digests of all paragraphs in order."""
    return F.transform(F.flatten(tree_col), _node)


def root(tree_col: Column) -> Column:
    return _node(F.transform(tree_col, lambda s: _node(F.transform(s, _node))))


def leaf_set(tree_col: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree_col)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else twice the common distinct leaves over the sum of both counts."""
    total = F.size(leaves_a) + F.size(leaves_b)
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(root_a == root_b, 1.0).when(total == 0, 0.0).otherwise(F.lit(2.0) * common / total)


def first_difference(paragraphs_a: Column, paragraphs_b: Column) -> Column:
    """Number (from 0) of the first paragraph in which two texts differ, null if in none."""
    longest = F.greatest(F.size(paragraphs_a), F.size(paragraphs_b))
    same = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.get(paragraphs_a, i).eqNullSafe(F.get(paragraphs_b, i)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).cast("long")


def _with_tree(df: DataFrame, text: str, root_col: str, leaves_col: str, paragraphs_col: str | None = None) -> DataFrame:
    """Root, distinct leaves and, if named, paragraph digests of a text; no text is cut and no node hashed twice."""
    others = df.columns
    cut = df.select(*others, tree(F.col(text)).alias("_tree"))
    nodes = cut.select(*others, F.transform("_tree", lambda s: F.transform(s, _node)).alias("_nodes"), leaf_set(F.col("_tree")).alias(leaves_col))
    found = [_node(F.transform("_nodes", _node)).alias(root_col), leaves_col]
    return nodes.select(*others, *found, *([F.flatten("_nodes").alias(paragraphs_col)] if paragraphs_col else []))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET, trees: bool = False) -> DataFrame:
    """(_id, _text, _next): each text with the one that follows in descending id, the first after the last.

    Texts move once: neighbours meet in small ranges of the id, and only the first text of each
    range is also sent to the range before it. Repeated ids are ordered by text hash, null ids
    come last; null text counts as empty. A single row follows itself. With ``trees``, also the roots
    and leaves of both, (_ra, _la) and (_rn, _ln), and the text's paragraphs _pa: every text's tree is
    built once, where it lies, and goes along to the text before it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_bucket", range_buckets(rows.select("_id"), "_id", rows_per_bucket))
    # a bucket's first id and the bucket before it: one row for each bucket
    firsts = rows.groupBy("_bucket").agg(F.max("_id").alias("_first"))
    whole = Window.orderBy(F.col("_bucket").desc())
    before = F.coalesce(F.lag("_bucket").over(whole), F.min("_bucket").over(Window.partitionBy()))
    firsts = firsts.select(F.col("_bucket").alias("_of"), "_first", before.alias("_to"))
    edges = rows.join(firsts, (F.col("_bucket") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_first")))
    edges = edges.groupBy("_to").agg(F.min_by("_text", F.xxhash64("_text")).alias("_edge"))
    moved = {"_text": "_next"}
    if trees:
        moved |= {"_ra": "_rn", "_la": "_ln"}
        rows = _with_tree(rows.repartition("_bucket"), "_text", "_ra", "_la", "_pa")
        edges = _with_tree(edges, "_edge", "_edge_ra", "_edge_la")
    edges = edges.withColumnRenamed("_edge", "_edge_text")
    inside = Window.partitionBy("_bucket").orderBy(F.col("_id").desc_nulls_last(), F.xxhash64("_text"))
    led = rows.select("*", *[F.lead(c).over(inside).alias(f"_lead{c}") for c in moved])
    return led.join(edges, F.col("_bucket") == F.col("_to"), "left").select(
        "_id", "_text", *(["_ra", "_la", "_pa"] if trees else []), *[F.coalesce(f"_lead{c}", f"_edge{c}").alias(n) for c, n in moved.items()])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike trees are.

    The edited text has its last third of code points replaced by the beginning of the next
    document, in descending id. One row per row of ``docs``: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, first_edit (the first paragraph
    that differs, null if none). An empty table gives no row.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs, id_col, text_col, trees=True).withColumn("n_chars", F.length("_text"))
    rows = rows.withColumn("_edited", F.concat(F.expr("left(_text, n_chars - cast(floor(n_chars / 3) as int))"), F.substring(F.col("_next"), F.lit(1), third)))
    edited = rows.select(F.col("_id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "_ra", "_la", "_pa", "_rn", "_ln", "_edited")
    return _with_tree(edited, "_edited", "_re", "_le", "_pe").select(
        id_col, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.col("_ra").alias("fingerprint"), F.col("_re").alias("edited_fingerprint"),
        likeness(F.col("_ra"), F.col("_la"), F.col("_re"), F.col("_le")).alias("near_edited"),
        likeness(F.col("_ra"), F.col("_la"), F.col("_rn"), F.col("_ln")).alias("near_next"),
        first_difference(F.col("_pa"), F.col("_pe")).alias("first_edit"))
