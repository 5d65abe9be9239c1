"""Rendezvous hashing of stable record keys over weighted shards.

Every shard bids for a key with weight / -ln(u), u being a hash of key and shard between 0
and 1; the highest bid wins. A shard's bids do not depend on the other shards, so one shard
more takes only the keys that it wins, and one shard less gives away only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sorrel.llm.order import range_buckets

#: Records numbered together when slots are given out.
ROWS_PER_BUCKET = 4096


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """A shard's bid for a key (text): 52 bits of an MD5 as a number between 0 and 1, scaled by the weight."""
    bits = F.conv(F.substring(F.md5(F.encode(F.concat(key, F.lit("/"), shard.cast("string")), "UTF-8")), 1, 13), 16, 10).cast("double")
    return weight / -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def shard_of(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """(shard, bid) of the winner; the lower shard wins ties. Shards of weight 0 never win."""
    bids = F.array(*[F.struct(bid(key, F.lit(s), F.lit(float(w))).alias("b"), F.lit(-s).alias("s")) for s, w in enumerate(weights) if w > 0])
    best = F.array_max(bids)
    return (-best["s"]).cast("int"), best["b"]


def shard_records(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, new_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    ``slot`` numbers the records of a shard from 0 without gaps in order of id (null ids first,
    their key being empty text), then checksum and size; equal records take consecutive slots.
    ``grown_shard`` is the shard once a shard of ``new_weight`` is added. Null text has size 1.
    Only keys, sizes and checksums move. An empty table gives no row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # copies of a record are one row with a count, so none of them is a crowd
    kinds = rows.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    shard, best = shard_of(key, weights)
    placed = kinds.withColumn("shard", shard).withColumn("_best", best)
    placed = placed.withColumn("grown_shard", F.when(bid(key, F.lit(len(weights)), F.lit(float(new_weight))) > F.col("_best"), len(weights)).otherwise(F.col("shard")).cast("int"))
    placed = placed.withColumn("_bucket", range_buckets(docs.select(F.col(id_col).cast("long").alias("_id")), "_id", rows_per_bucket * len(weights)))
    totals = placed.groupBy("shard", "_bucket").agg(F.sum("_copies").alias("_total"))
    upto = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "_bucket", F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(starts, ["shard", "_bucket"])
    return numbered.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("_start") + F.col("_before"), F.col("_start") + F.col("_before") + F.col("_copies") - 1)).alias("slot"), "grown_shard")
