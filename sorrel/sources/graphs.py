"""Concept graphs as nested JSON, part instances, part-type graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.text import is_visible, norm
from sorrel.functions.vectors import unit
from sorrel.operators.scan import dense_numbers

_ATTR = "struct<name string, value string, source string>"
GRAPH_SCHEMA = (f"concept string, global_attrs array<{_ATTR}>, parts array<struct<name string, attributes array<{_ATTR}>, "
                "exemplar_crop string, embeddings map<string,array<double>>>>, concept_embeddings map<string,array<double>>, "
                "anchor string, delta array<string>, ref_paths array<string>, ref_embeddings array<array<double>>")
INSTANCE_SCHEMA = "id string, concept string, part string, ref_path string, crop_path string, siglip2 array<double>"


def read_graphs(spark: SparkSession, pattern: str) -> DataFrame:
    """One nested row per concept file."""
    return spark.read.schema(GRAPH_SCHEMA).option("multiLine", "true").json(pattern)


def part_exemplars(graphs: DataFrame, model: str = "siglip2") -> DataFrame:
    """(concept, part, crop_path, vec): unit exemplar vectors, parts without a vector left out."""
    p = graphs.select("concept", F.explode("parts").alias("p"))
    vec = F.try_element_at("p.embeddings", F.lit(model))
    return p.where(F.coalesce(F.size(vec), F.lit(0)) > 0).select("concept", F.col("p.name").alias("part"), F.col("p.exemplar_crop").alias("crop_path"), unit(vec).alias("vec"))


def visible_attributes(graphs: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """(concept, part, attr, value) normalised, hidden values dropped, limited to (part, attr) in the whitelist."""
    a = graphs.select("concept", F.explode("parts").alias("p")).select("concept", F.col("p.name").alias("part"), F.explode("p.attributes").alias("a"))
    rows = a.where(is_visible("a.value")).select("concept", "part", F.col("a.name").alias("attr"), norm("a.value").alias("value"))
    return rows if whitelist is None else rows.join(whitelist.select("part", "attr").distinct(), ["part", "attr"], "left_semi").select("concept", "part", "attr", "value")


def read_part_instances(spark: SparkSession, pattern: str) -> DataFrame:
    """Part instances of files holding JSON lists; files of another shape give nothing."""
    return instance_rows(spark.read.text(pattern, wholetext=True).select(F.try_parse_json("value").alias("v")))


def instance_rows(raw: DataFrame) -> DataFrame:
    """Instances of a variant column ``v`` holding lists."""
    rows = raw.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("e"))
    pick = lambda n, t="string": F.try_variant_get("e", f"$.{n}", t).alias(n)
    return rows.select(pick("id"), pick("concept"), pick("part"), pick("ref_path"), pick("crop_path"),
                       F.try_variant_get("e", "$.siglip2", "array<double>").alias("vec")).where(F.col("id").isNotNull())


def write_part_graph(path: str, hub: DataFrame, member: DataFrame, instance: DataFrame) -> None:
    for name, df in (("hub", hub), ("hub_member", member), ("part_instance", instance)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_part_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("hub", "hub_member", "part_instance")}


def taxonomy_dimension(species: DataFrame, family: str = "family") -> DataFrame:
    """Add a dense family id over sorted family names; unknown families stay NULL."""
    names = species.where(F.col(family).isNotNull()).select(family).distinct()
    return species.join(dense_numbers(names, family, "family_id"), family, "left")


def multi_member_families(species: DataFrame, family: str = "family") -> DataFrame:
    return species.where(F.col(family).isNotNull()).groupBy(family).agg(F.count(F.lit(1)).alias("n_members")).where("n_members >= 2")
