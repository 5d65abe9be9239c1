"""Identifiers, prompts, provenance hashes and box arithmetic as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.text import EDIT_PROMPT, QUERY_PLAIN, QUERY_TYPED, SCENE_FRAMES, col, is_visible


def image_id(species, method, name_mode, ip_scale, seed) -> Column:
    scale = F.coalesce(col(ip_scale).cast("string"), F.lit("None"))
    return F.concat_ws("|", col(species), col(method), col(name_mode), F.concat(F.lit("ip"), scale), F.concat(F.lit("seed"), col(seed).cast("string")))


def id_to_filename(ident) -> Column:
    return F.concat(F.translate(col(ident), "|/", "__"), F.lit(".png"))


def global_id(dataset, key) -> Column:
    return F.concat_ws(":", col(dataset), col(key).cast("string"))


def hub_key(dataset, rank, name) -> Column:
    return F.concat_ws(":", col(dataset), col(rank), col(name))


def split_global_id(gid) -> tuple[Column, Column]:
    """(dataset, key): cut at the first colon, so keys may contain colons."""
    g = col(gid)
    return F.substring_index(g, ":", 1), F.when(g.contains(":"), F.regexp_replace(g, "^[^:]*:", "")).otherwise("")


def common_name(class_name) -> Column:
    return F.translate(F.regexp_replace(col(class_name), "^[^.]*\\.", ""), "_", " ")


def genus(scientific) -> Column:
    return F.element_at(F.split(F.trim(col(scientific)), "\\s+"), 1)


def padded_key(number, width: int = 5) -> Column:
    n = col(number).cast("string")
    return F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0"))


def safe_id(name) -> Column:
    return F.translate(col(name), " -'", "__")


def concept_token(concept, neutral) -> Column:
    return F.when(F.col(neutral) if isinstance(neutral, str) else F.lit(neutral), "plant").otherwise(col(concept))


def attribute_phrases(global_attrs: str, parts: str) -> Column:
    """Attribute phrases, whole-concept ones first, those read from images first inside each block."""
    def block(pairs: Column) -> Column:
        vision = F.filter(pairs, lambda p: F.coalesce(p["source"] == "vision", F.lit(False)))
        other = F.filter(pairs, lambda p: ~F.coalesce(p["source"] == "vision", F.lit(False)))
        return F.concat(F.transform(vision, lambda p: p["text"]), F.transform(other, lambda p: p["text"]))

    whole = F.transform(F.col(global_attrs), lambda a: F.struct(a["source"].alias("source"), F.concat(a["name"], F.lit(": "), a["value"]).alias("text")))
    per_part = F.flatten(F.transform(F.col(parts), lambda p: F.transform(p["attributes"], lambda a: F.struct(
        a["source"].alias("source"), F.concat(p["name"], F.lit(" "), a["name"], F.lit(": "), a["value"]).alias("text")))))
    return F.concat(block(whole), block(per_part))


def compose_prompt(concept, phrases: Column, neutral=True, max_attrs: int = 8) -> Column:
    return F.concat(F.lit("a photo of a "), concept_token(concept, neutral), F.lit(", "), F.array_join(F.slice(phrases, 1, max_attrs), ", "))


def bare_prompt(concept, neutral=True) -> Column:
    return F.concat(F.lit("a photo of a "), concept_token(concept, neutral))


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def reference_query(concept, coarse) -> Column:
    """Retrieval text, naming the coarse type when it differs from the concept."""
    c, k = F.trim(col(concept)), F.trim(F.coalesce(col(coarse), F.lit("")))
    return F.when((k != "") & (F.lower(k) != F.lower(c)), _fill(QUERY_TYPED, concept=c, coarse=k)).otherwise(_fill(QUERY_PLAIN, concept=c))


def scene_prompt(concept, index) -> Column:
    frames = F.array(*[F.lit(f) for f in SCENE_FRAMES])
    frame = F.element_at(frames, (F.pmod(col(index), F.lit(len(SCENE_FRAMES))) + 1).cast("int"))
    return F.replace(frame, F.lit("{c}"), col(concept))


def edit_prompt(prompt, coarse, concept) -> Column:
    return _fill(EDIT_PROMPT, coarse=col(coarse), concept=col(concept), prompt=col(prompt))


def target_attributes_map(attributes: str, source: str) -> Column:
    """Keep target slots of a map slot -> struct(value, support, visible_count, is_target), adding the source."""
    kept = F.map_filter(F.col(attributes), lambda k, v: F.coalesce(v["is_target"], F.lit(False)))
    return F.transform_values(kept, lambda k, v: F.struct(
        v["value"].alias("value"), v["support"].cast("int").alias("support"), v["visible_count"].cast("int").alias("visible_count"),
        F.lit(source).alias("source")))


def part_attributes_map(parts: str, default_source: str = "graph") -> Column:
    """Map "part.name" -> struct with NULL counts from nested parts, hidden values dropped."""
    entries = F.flatten(F.transform(F.col(parts), lambda p: F.transform(
        F.filter(p["attributes"], lambda a: is_visible(a["value"])), lambda a: F.struct(
            F.concat(p["name"], F.lit("."), a["name"]).alias("key"), F.struct(
                a["value"].alias("value"), F.lit(None).cast("int").alias("support"), F.lit(None).cast("int").alias("visible_count"),
                F.coalesce(a["source"], F.lit(default_source)).alias("source")).alias("value")))))
    # a repeated name keeps its last value
    empty = F.map_from_entries(F.filter(entries, lambda e: F.lit(False)))
    return F.aggregate(entries, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


# --- hashes ---------------------------------------------------------------------

def content_sha256(content) -> Column:
    return F.sha2(col(content).cast("binary"), 256)


def content_md5(content) -> Column:
    return F.md5(col(content).cast("binary"))


def entry_sha256(columns: Sequence[str]) -> Column:
    """Hash of a record's JSON with keys in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def policy_sha256(policy: str) -> Column:
    """Hash of a map column, independent of entry order."""
    return F.sha2(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.col(policy))))), 256)


# --- boxes ------------------------------------------------------------------------

def clamp_box(x0, y0, x1, y1, width, height) -> Column:
    """Corners rounded half to even, ordered and kept inside the frame."""
    def axis(a, b, size):
        lo, hi = F.least(col(a), col(b)), F.greatest(col(a), col(b))
        keep = lambda v: F.greatest(F.lit(0), F.least(F.bround(v, 0).cast("int"), col(size).cast("int")))
        return keep(lo), keep(hi)

    (l, r), (t, b) = axis(x0, x1, width), axis(y0, y1, height)
    return F.struct(l.alias("x0"), t.alias("y0"), r.alias("x1"), b.alias("y1"))


def box_share(n_inside, x0, y0, x1, y1) -> Column:
    """Marked pixels as a share of the box area, an empty box counting as one pixel."""
    area = F.greatest(F.lit(1), (col(x1) - col(x0)) * (col(y1) - col(y0)))
    return col(n_inside).cast("double") / area.cast("double")


def shifted_interval(center, side, size) -> tuple[Column, Column]:
    """An interval of length ``side`` around ``center`` moved, not shrunk, into [0, size]."""
    c, s, z = col(center), col(side), col(size).cast("double")
    lo = F.greatest(F.lit(0.0), F.least(c - s / 2, z - s))
    return F.when(s >= z, F.lit(0.0)).otherwise(lo), F.when(s >= z, z).otherwise(lo + s)
