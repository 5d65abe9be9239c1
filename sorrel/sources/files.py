"""Readers and writers for image folders, sidecars, label and annotation files, JSON bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.text import norm


def image_folder(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png}", content: bool = False) -> DataFrame:
    """Files under one sub-directory per class: class, path, stem, size and optionally content and its MD5."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root))
    parts = F.split("path", "/")
    out = raw.select(F.element_at(parts, -2).alias("class"), "path", F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "").alias("stem"),
                     "length", *(["content", F.md5("content").alias("digest")] if content else []))
    return out


def image_classes(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Class names with their file counts; contents are not read."""
    return image_folder(spark, root, pattern).groupBy("class").agg(F.count(F.lit(1)).alias("n_files"))


def caption_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(stem, caption) of JSON sidecars; an unreadable one keeps a NULL caption."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(root)
    obj = F.try_parse_json(F.col("content").cast("string"))
    return raw.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "").alias("stem"),
                      F.try_variant_get(obj, "$.caption", "string").alias("caption"))


def keyed_lines(spark: SparkSession, path: str, name: str, key: str = "id") -> DataFrame:
    """``<id> <text with spaces>`` lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    cut = F.split("value", " ", 2)
    return lines.select(F.get(cut, F.lit(0)).cast("long").alias(key), F.trim(F.get(cut, F.lit(1))).alias(name))


def numeric_lines(spark: SparkSession, path: str, names: Sequence[str], key: str = "id") -> DataFrame:
    """``<id> <number> ...`` lines."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("_t")).where(F.size("_t") > 1)
    return lines.select(F.get("_t", F.lit(0)).cast("long").alias(key), *[F.get("_t", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)])


def part_points(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """(image_id, part, x, y, visible) of known parts; points of unknown part ids are dropped."""
    raw = numeric_lines(spark, path, ["part_id", "x", "y", "visible"], "image_id")
    named = parts.select(F.col("part_id").cast("double").alias("part_id"), "part")
    return raw.join(named, "part_id").select("image_id", "part", "x", "y", (F.col("visible").cast("int") != 0).alias("visible"))


def species_csv(spark: SparkSession, path: str, schema: str, wanted: DataFrame, species: str = "species") -> DataFrame:
    """Rows of a ``;`` CSV whose species is exactly in the list; malformed rows are dropped."""
    rows = (spark.read.schema(schema).option("sep", ";").option("header", "true").option("mode", "DROPMALFORMED")
            .option("maxCharsPerColumn", "-1").option("multiLine", "false").csv(path))
    return rows.join(wanted.select(species).distinct(), species, "left_semi")


def label_csv(spark: SparkSession, path: str, schema: str, verdicts: Sequence[str] = ("verdict", "verdict_identity")) -> DataFrame:
    """Label rows with normalised verdicts; blanks become NULL, other values are kept for checking."""
    rows = spark.read.schema(schema).option("header", "true").csv(path)
    for v in verdicts:
        if v in rows.columns:
            rows = rows.withColumn(v, F.nullif(norm(v), F.lit("")))
    return rows


def selected_shard_rows(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], ids: DataFrame, ident: str) -> DataFrame:
    """Chosen rows of a sharded Parquet table, reading only the named columns."""
    return spark.read.parquet(*paths).select(*columns).join(ids.select(ident).distinct(), ident, "left_semi")


BUNDLE_SCHEMA = ("categories array<struct<id long, name string, class string, family string>>, "
                 "images array<struct<id long, file_name string>>, "
                 "annotations array<struct<image_id long, category_id long>>")


def annotation_bundle(spark: SparkSession, path: str, schema: str = BUNDLE_SCHEMA) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, images, annotations) of a bundle of three arrays."""
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return tuple(raw.select(F.explode(c).alias("_e")).select("_e.*") for c in ("categories", "images", "annotations"))


def species_images(categories: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Image of each category: (category_id, image_id, file_name), each pair once."""
    pairs = annotations.select("image_id", "category_id").distinct()
    return (pairs.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
            .join(categories.select(F.col("id").alias("category_id")), "category_id").select("category_id", "image_id", "file_name"))


def cell_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One JSON object per result file, collected by glob."""
    return spark.read.schema(schema).option("multiLine", "true").json(pattern)


def species_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, eligible, eval_set, valid) of a JSON object of entries per file."""
    return manifest_rows(spark.read.text(path, wholetext=True))


def manifest_rows(texts: DataFrame) -> DataFrame:
    """Manifest entries of JSON texts in ``value``; ``valid`` checks list types per entry."""
    raw = texts.select(F.parse_json("value").alias("v"))
    entries = raw.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "entry"))
    lists = lambda name: F.try_variant_get("entry", f"$.{name}", "array<string>")
    kind = lambda name: F.schema_of_variant(F.try_variant_get("entry", f"$.{name}", "variant"))
    ok = F.coalesce(kind("eligible").startswith("ARRAY"), F.lit(False)) & F.coalesce(kind("eval_set").startswith("ARRAY"), F.lit(True))
    return entries.select("key", lists("eligible").alias("eligible"), lists("eval_set").alias("eval_set"), ok.alias("valid"))


def write_results(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Row results as JSON lines or CSV with a header."""
    w = rows.write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.json(path)


# fixed values
PART_GROUPS = {
    "head": ("beak", "crown", "forehead", "left eye", "right eye", "throat", "nape"),
    "back": ("back",),
    "breast": ("breast", "belly"),
    "wing": ("left wing", "right wing"),
    "leg": ("left leg", "right leg"),
    "tail": ("tail",),
}


def with_part_group(points: DataFrame, groups: dict[str, Sequence[str]] = PART_GROUPS) -> DataFrame:
    """Points of grouped parts with their group."""
    group = F.coalesce(*[F.when(F.col("part").isin(*names), F.lit(g)) for g, names in groups.items()])
    return points.withColumn("part_group", group).where(F.col("part_group").isNotNull())


def source_images(images: DataFrame, points: DataFrame, species: str = "species") -> DataFrame:
    """Per species the image with most visible part groups, lowest id on ties."""
    n = points.where("visible").groupBy("image_id").agg(F.countDistinct("part_group").alias("n_groups"))
    j = images.join(n, "image_id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    return j.groupBy(species).agg(F.min_by("image_id", F.struct(-F.col("n_groups"), F.col("image_id"))).alias("image_id"), F.max("n_groups").alias("n_groups"))


def group_crops(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Square crop per image and visible part group.

    Centred on the mean visible point; side max(32, 45 % of the larger box side) with
    half-even rounding; moved inside the frame of (image_id, box_w, box_h, width, height).
    """
    from sorrel.functions.names import shifted_interval

    c = points.where("visible").groupBy("image_id", "part_group").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    j = c.join(boxes, "image_id").withColumn("side", F.greatest(F.lit(32), F.bround(0.45 * F.greatest("box_w", "box_h"), 0).cast("int")).cast("double"))
    (l, r), (t, b) = shifted_interval("cx", "side", "width"), shifted_interval("cy", "side", "height")
    whole = lambda v: F.bround(v, 0).cast("int")
    return j.select("image_id", "part_group", whole(l).alias("x0"), whole(t).alias("y0"), whole(r).alias("x1"), whole(b).alias("y1"))
