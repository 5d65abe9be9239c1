"""Species store as tables: records, items, attributes, relations, postings, vectors.

The nested record of a species would put all its items into one row, so the store keeps
one row per species and long tables keyed by ``global_id``; a record is joined together
only for the ids asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.names import split_global_id
from sorrel.functions.vectors import norm, unit
from sorrel.operators.groups import medoids
from sorrel.operators.scan import dense_numbers
from sorrel.operators.similarity import top_k
from sorrel.session import cut, exists

TABLES = ("record", "item", "attribute", "relation", "posting", "vector")


def build_records(species: DataFrame, items: DataFrame, attributes: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Store tables from per-species inputs.

    species (global_id, scientific_name, common_name, taxonomy map), items (global_id,
    ref, path, part, ord, vec), attributes (global_id, slot, value, support,
    visible_count, source), relations (global_id, type, target). Further columns of the
    species, such as provenance, stay with the record. The medoid is the item
    nearest its species mean; the first item of each part is its crop. Species without
    items go to ``skipped``.
    """
    # read by several tables, each written by its own job
    med = cut(medoids(items, ["global_id"], "ref", full_cosine=True).select("global_id", F.col("ref").alias("medoid_ref")))
    n = items.groupBy("global_id").agg(F.count(F.lit(1)).alias("k_images"))
    record = species.join(n, "global_id").join(med, "global_id").withColumn("dataset", split_global_id("global_id")[0])
    crops = (items.where(F.col("part").isNotNull()).groupBy("global_id", F.col("part").alias("part_type"))
             .agg(F.min_by("ref", F.struct("ord", "ref")).alias("ref")).select("global_id", "part_type", "ref"))
    item = items.select("global_id", "ref", "path", F.lit("candidate").alias("kind"), F.lit(None).cast("string").alias("part_type"))
    item = item.unionByName(crops.join(items.select("global_id", "ref", "path"), ["global_id", "ref"]).select(
        "global_id", "ref", "path", F.lit("part_crop").alias("kind"), F.col("part_type").cast("string").alias("part_type")))
    item = item.unionByName(med.join(items.select("global_id", "ref", "path"), (F.col("medoid_ref") == F.col("ref")) & (med.global_id == items.global_id))
                            .select(med.global_id, "ref", "path", F.lit("medoid").alias("kind"), F.lit(None).cast("string").alias("part_type")))
    vector = items.select("ref", "global_id", "path", unit("vec").alias("vec"))
    keep = lambda d: d.join(n.select("global_id"), "global_id", "left_semi")
    attribute, relation = keep(attributes), keep(relations)
    return {"record": record, "item": item, "attribute": attribute, "relation": relation,
            "posting": postings(attribute, relation, item), "vector": vector,
            "skipped": species.join(n, "global_id", "left_anti").select("global_id", F.lit("no items").alias("reason"))}


def postings(attribute: DataFrame, relation: DataFrame, item: DataFrame) -> DataFrame:
    """(index, key, global_id, ref) rows: attribute ``slot|value``, hub, and part type.

    One row per posting instead of a list per key: a key holding most species stays many rows.
    """
    none = F.lit(None).cast("long").alias("ref")
    a = attribute.select(F.lit("attribute").alias("index"), F.concat_ws("|", "slot", "value").alias("key"), "global_id", none)
    h = relation.where(F.col("type") == "instance_of").select(F.lit("hub").alias("index"), F.col("target").alias("key"), "global_id", none)
    p = item.where(F.col("kind") == "part_crop").select(F.lit("part").alias("index"), F.col("part_type").alias("key"), "global_id", F.col("ref").cast("long").alias("ref"))
    return a.unionByName(h).unionByName(p)


def write_store(tables: dict[str, DataFrame], path: str, encoder: str, dim: int) -> None:
    """Write the tables: records by dataset, postings by index and sorted by key, and the vector stamp."""
    for name in TABLES:
        if name not in tables:
            continue  # vectors are optional
        df = tables[name]
        w = df.write.mode("overwrite")
        if name == "record":
            w = w.partitionBy("dataset")
        elif name == "posting":
            w = df.repartitionByRange("index", "key", "global_id").sortWithinPartitions("index", "key", "global_id").write.mode("overwrite").partitionBy("index")
        w.parquet(f"{path}/{name}")
    stamp = tables["record"].sparkSession.range(1).select(F.lit(encoder).alias("encoder"), F.lit(dim).alias("dim"), F.lit(True).alias("normalized"))
    stamp.coalesce(1).write.mode("overwrite").parquet(f"{path}/stamp")


def read_store(spark: SparkSession, path: str, encoder: str | None = None, dim: int | None = None) -> dict[str, DataFrame]:
    """The store's tables, lazily; a vector stamp other than the expected one is an error.

    A store written without vectors has no ``vector`` entry.
    """
    if encoder is not None or dim is not None:
        stamp = spark.read.parquet(f"{path}/stamp").first()
        if (encoder or stamp["encoder"], dim or stamp["dim"]) != (stamp["encoder"], stamp["dim"]):
            raise ValueError(f"store holds {stamp['encoder']}/{stamp['dim']}, expected {encoder}/{dim}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES if name != "vector"}
    if exists(spark, f"{path}/vector"):
        tables["vector"] = spark.read.parquet(f"{path}/vector")
    return tables


def build_vectors(items: DataFrame, ident: str, vec: str, kind: str = "candidate") -> DataFrame:
    """Unit vectors with dense integer refs over the order of the ids, which may be of any type.

    Vectors of different lengths are an error. Rows that repeat an id share its ref.
    """
    low, high = items.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    refs = dense_numbers(items, ident, "ref")
    return items.select(ident, unit(vec).alias("vec")).join(refs, ident).select("ref", ident, F.lit(kind).alias("kind"), "vec", norm("vec").alias("norm"))


def lookup(posting: DataFrame, record: DataFrame, hub: str | None = None, attribute: tuple[str, str] | None = None,
           part_type: str | None = None) -> DataFrame:
    """Ids matching every given filter; all ids without a filter."""
    ids = record.select("global_id")
    for index, key in (("hub", hub), ("attribute", "|".join(attribute) if attribute else None), ("part", part_type)):
        if key is not None:
            hit = posting.where((F.col("index") == index) & (F.col("key") == key)).select("global_id")
            ids = ids.join(hit, "global_id", "left_semi")
    return ids


def members(posting: DataFrame, hub: str) -> DataFrame:
    return posting.where((F.col("index") == "hub") & (F.col("key") == hub)).select("global_id").distinct()


def get_records(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Full records of the asked ids, one row each: the columns of ``record`` (``provenance`` among
    them where the species had it), ``attributes`` as a map, ``medoid``, ``candidates`` and
    ``part_crops`` by ref, and ``relations``. A record holds all items of its species.
    """
    attrs = tables["attribute"].join(ids, "global_id", "left_semi").groupBy("global_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "slot", F.struct("value", "support", "visible_count", "source")))).alias("attributes"))
    entry = F.struct("ref", "path")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    items = tables["item"].join(ids, "global_id", "left_semi").groupBy("global_id").agg(
        F.min(of("medoid", entry)).alias("medoid"), F.sort_array(F.collect_list(of("candidate", entry))).alias("candidates"),
        F.sort_array(F.collect_list(of("part_crop", F.struct("part_type", "ref", "path")))).alias("part_crops"))
    relations = tables["relation"].join(ids, "global_id", "left_semi").groupBy("global_id").agg(
        F.sort_array(F.collect_list(F.struct("type", "target"))).alias("relations"))
    out = tables["record"].join(ids, "global_id", "left_semi")
    for part in (attrs, items, relations):
        out = out.join(part, "global_id", "left")
    return out


def part_images(item: DataFrame, ids: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """First crop per species and part type."""
    c = item.where(F.col("kind") == "part_crop").join(ids, "global_id", "left_semi")
    if parts is not None:
        c = c.where(F.col("part_type").isin(parts))
    return c.groupBy("global_id", "part_type").agg(F.min_by("path", "ref").alias("path"))


def search_vectors(vectors: DataFrame, queries: DataFrame, k: int, *, kind=None, allow: DataFrame | None = None,
                   exclude_self: bool = False) -> DataFrame:
    """Top-k of (ref, global_id, kind, vec) with metadata filters applied before ranking."""
    pool = vectors if kind is None else vectors.where(F.col("kind") == kind)
    if allow is not None:
        pool = pool.join(allow.select("global_id").distinct(), "global_id", "left_semi")
    pool = pool.withColumn("_self", F.col("ref"))
    q = queries.withColumn("_self", F.col("query_id"))
    return top_k(q, pool, k, doc_id="ref", tag="_self" if exclude_self else None).drop("doc_tag")


def nearest_crops(tables: dict[str, DataFrame], queries: DataFrame, k: int, part_type: str | None = None, hub: str | None = None) -> DataFrame:
    """Nearest items narrowed by hub members and part postings before ranking; none without vectors."""
    if "vector" not in tables:
        return queries.select("query_id", F.lit(None).cast("long").alias("ref"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    pool = tables["vector"]
    if part_type is not None:
        refs = tables["posting"].where((F.col("index") == "part") & (F.col("key") == part_type)).select("ref").distinct()
        pool = pool.join(refs, "ref", "left_semi")
    return search_vectors(pool, queries, k, allow=members(tables["posting"], hub) if hub is not None else None)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Per dataset: species, species with attributes, slots, medoids, crops and candidates."""
    ds = tables["record"].select("global_id", "dataset")
    a = tables["attribute"].groupBy("global_id").agg(F.count(F.lit(1)).alias("slots"))
    kinds = tables["item"].groupBy("global_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("medoid", "part_crop", "candidate")])
    j = ds.join(a, "global_id", "left").join(kinds, "global_id", "left").fillna(0)
    return j.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_species"), F.count_if(F.col("slots") > 0).alias("species_with_attributes"), F.sum("slots").alias("attribute_slots"),
        F.sum("medoid").alias("n_medoids"), F.sum("part_crop").alias("n_crops"), F.sum("candidate").alias("n_candidates"))


def hub_sizes(posting: DataFrame) -> DataFrame:
    return posting.where(F.col("index") == "hub").groupBy("key").agg(F.count(F.lit(1)).alias("n_members"))
