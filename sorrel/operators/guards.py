"""Deduplication, contamination and leakage guards, and table checks returning violations.

A check is a DataFrame (severity, code, ident, message); empty means clean. ``enforce``
turns error rows into a failure.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.scores import finite
from sorrel.functions.text import norm
from sorrel.session import cut


def violation(df: DataFrame, severity: str, code: str, ident, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                     (F.col(ident) if isinstance(ident, str) else ident).cast("string").alias("ident"), message.alias("message"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def enforce(violations: DataFrame) -> None:
    """Raise on the first error row."""
    bad = violations.where(F.col("severity") == "error").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['code']}: {bad[0]['message']}")


# --- duplicates and contamination ----------------------------------------------------

def content_dedup(df: DataFrame, keys: Sequence[str], digest: str, path: str, *keep: str) -> DataFrame:
    """First path per key and content hash. Combines on the map side, so a mass of copies is cheap."""
    more = [F.min_by(c, path).alias(c) for c in keep]
    return df.groupBy(*keys, digest).agg(F.min(path).alias(path), *more)


def contamination(candidates: DataFrame, truth: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Candidates byte-equal to a reference of their own case."""
    return candidates.join(truth.select(*keys, digest).distinct(), [*keys, digest], "left_semi")


def eligible_pool(pool: DataFrame, evaluation: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Add ``reason`` (NULL for kept rows): unhashable, duplicate or contamination.

    ``order`` must be unique over all rows. Every copy of an evaluation item is
    contamination, since none of them is ever kept. Kept rows are the minimum order per
    (key, digest); they are matched back by the unique order, not by the digest, so a
    digest shared by a third of the rows does not pile up in one task. Only the
    contamination flag is joined by digest, against one row per evaluation hash.
    Keys and digests are written out once, so contents are read and hashed a single time.
    """
    more = [c for c in pool.columns if c not in {key, order, digest}]
    slim = cut(pool.select(key, order, digest))
    seen = slim.where(F.col(digest).isNotNull()).groupBy(key, digest).agg(F.min(order).alias("_first"))
    dirty = cut(evaluation.where(F.col(digest).isNotNull()).select(key, digest).distinct()).withColumn("_dirty", F.lit(True))
    kept = seen.join(dirty, [key, digest], "left_anti").select(F.col("_first").alias(order), F.lit(True).alias("_kept"))
    marked = slim.join(kept, order, "left")
    flagged = marked.where(F.col("_kept").isNull() & F.col(digest).isNotNull()).join(dirty, [key, digest], "left_semi").select(
        order, F.lit(True).alias("_dirty"))
    marked = marked.join(flagged, order, "left")
    reason = (F.when(F.col(digest).isNull(), "unhashable").when(F.col("_kept"), F.lit(None).cast("string"))
              .when(F.col("_dirty"), "contamination").otherwise("duplicate"))
    out = marked.withColumn("reason", reason).drop("_kept", "_dirty")
    return out.join(pool.select(order, *more), order) if more else out


def kept_in_eval(pool: DataFrame, eval_paths: DataFrame, key: str, path: str) -> DataFrame:
    """Violations: a kept path also listed for evaluation."""
    leaked = pool.where(F.col("reason").isNull()).join(eval_paths.select(key, path).distinct(), [key, path], "left_semi")
    return violation(leaked, "error", "eligible_in_eval", path, F.concat(F.lit("eligible path also in the evaluation set: "), F.col(path)))


def reason_tally(pool: DataFrame, key: str | None = None) -> DataFrame:
    by = [key] if key else []
    return pool.groupBy(*by, F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def path_leaks(refs: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """References equal to a corpus root or inside one.

    Every ancestor of a path is tried by equality, so it is an ordinary hash join and the
    number of roots does not matter.
    """
    pieces = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"))
    tried = refs.withColumn("_root", F.explode(ancestors))
    clean = roots.select(F.regexp_replace(F.col(root), "/+$", "").alias("_root")).distinct()
    return tried.join(clean, "_root").withColumnRenamed("_root", root)


def id_set_diff(left: DataFrame, right: DataFrame, ident: str) -> DataFrame:
    """Ids present on one side only, as (id, side) with side missing (right lacks it) or extra."""
    a = left.select(ident, F.lit(True).alias("_l")).distinct()
    b = right.select(ident, F.lit(True).alias("_r")).distinct()
    both = a.join(b, ident, "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        ident, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("side"))


def hash_mismatch(records: DataFrame, frozen: DataFrame, ident: str, digest: str) -> DataFrame:
    """Violations: record without a frozen hash, or with a different one."""
    j = records.join(frozen.select(ident, F.col(digest).alias("_frozen")), ident, "left")
    bad = j.where(F.col("_frozen").isNull() | ~F.col(digest).eqNullSafe(F.col("_frozen")))
    return violation(bad, "error", "hash_mismatch", ident, F.when(
        F.col("_frozen").isNull(), F.lit("no frozen hash")).otherwise(F.lit("hash differs from the frozen one")))


def missing_from(cases: DataFrame, sources: dict[str, DataFrame], ident: str) -> DataFrame:
    """Violations naming each case that some source lacks."""
    return union_all([violation(cases.join(s.select(ident).distinct(), ident, "left_anti"), "error", f"missing_{name}", ident,
                                F.concat(F.lit("case "), F.col(ident).cast("string"), F.lit(f" missing from {name}")))
                      for name, s in sources.items()])


def assemble(cases: DataFrame, sources: dict[str, DataFrame], ident: str) -> DataFrame:
    """Inner join of a case with each source table."""
    for s in sources.values():
        cases = cases.join(s, ident)
    return cases


# --- table checks -------------------------------------------------------------------

def label_domain(labels: DataFrame, column: str, ident: str = "case_id", allowed: Sequence[str] = ("pass", "fail", "")) -> DataFrame:
    v = F.coalesce(norm(column), F.lit(""))
    return violation(labels.where(~v.isin(*allowed)), "error", "bad_verdict", ident, F.concat(F.lit("unexpected value "), v))


def case_constraints(cases: DataFrame, coarse_refs: DataFrame | None = None, heldout: int = 1) -> DataFrame:
    """Checks on (id, prompt, concept, coarse, kind, cohort, n_refs) and (term, n_refs)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    out = [violation(cases.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "error", "duplicate_id", "id", F.lit("duplicate case id"))]
    out += [violation(cases.where(blank(c)), "error", f"no_{c}", "id", F.lit(f"case has no {c}")) for c in ("prompt", "concept", "coarse")]
    out.append(violation(cases.where(~blank("coarse") & (norm("coarse") == norm("concept"))), "error", "coarse_equals_concept", "id",
                         F.lit("coarse term must be a superordinate of the concept")))
    for c, domain, default in (("kind", ("target", "control"), "target"), ("cohort", ("bridge", "common"), "bridge")):
        out.append(violation(cases.where(~F.coalesce(F.col(c), F.lit(default)).isin(*domain)), "error", f"bad_{c}", "id", F.concat(F.lit(f"unexpected {c} "), F.col(c))))
    n = F.coalesce("n_refs", F.lit(0))
    out.append(violation(cases.where(n == 0), "error", "no_refs", "id", F.lit("case has no references")))
    out.append(violation(cases.where((n > 0) & (n - heldout < 1)), "error", "too_few_refs", "id", F.lit("holding out references leaves none to edit with")))
    if coarse_refs is not None:
        known = cases.select(F.col("coarse").alias("term")).distinct()
        out.append(violation(coarse_refs.join(known, "term", "left_anti"), "error", "unknown_coarse_term", "term", F.lit("not the coarse term of any case")))
        out.append(violation(coarse_refs.where(F.col("n_refs") < 3), "warning", "thin_coarse_refs", "term", F.lit("fewer than three coarse references")))
    return union_all(out)


def corpus_density(cases: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Warnings for concepts with fewer than ``k`` matches in (concept, n)."""
    lows = cases.select("id", F.lower("concept").alias("concept")).join(counts.select("concept", "n"), "concept", "left")
    thin = lows.where(F.coalesce("n", F.lit(0)) < k)
    return violation(thin, "warning", "corpus_thin", "id", F.concat(F.lit("fewer matches than needed for "), F.col("concept")))


def attach_density(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Corpus matches per row's concept: 0 means searched and absent, NULL unknown."""
    c = counts.select(F.col("concept").alias("_c"), F.col("n").alias("corpus_density"))
    return rows.join(c, F.lower("concept") == F.col("_c"), "left").drop("_c")


def usable_records(embeddings: str = "ref_embeddings", paths: str = "ref_paths") -> Column:
    n = F.coalesce(F.size(embeddings), F.lit(-1))
    return (n > 0) & (n == F.coalesce(F.size(paths), F.lit(-1)))


def vector_table_problems(tables: DataFrame, dims: DataFrame) -> DataFrame:
    """Checks of (name, encoder, dim, present) against known encoder dimensions (encoder, want)."""
    j = tables.join(dims, "encoder", "left")
    known = j.where(F.col("want").isNotNull())
    return union_all([
        violation(j.where(F.col("want").isNull()), "error", "unknown_encoder", "name", F.concat(F.lit("unknown encoder "), F.col("encoder"))),
        violation(known.where(F.col("dim").isNotNull() & (F.col("dim") != F.col("want"))), "error", "dim_mismatch", "name",
                  F.concat(F.lit("stored dimension "), F.col("dim").cast("string"), F.lit(", encoder gives "), F.col("want").cast("string"))),
        violation(known.where(~F.col("present")), "warning", "table_absent", "name", F.lit("vector table not built yet"))])


def missing_files(refs: DataFrame, files: DataFrame, ident: str, path: str) -> DataFrame:
    gone = refs.join(files.select(path).distinct(), path, "left_anti")
    return violation(gone, "warning", "missing_file", ident, F.concat(F.lit("no file at "), F.col(path)))


def run_sanity(rows: DataFrame, borrowed: DataFrame, conditions: Sequence[str], cell: Sequence[str] = ("concept", "part")) -> DataFrame:
    """One row of pass flags: equal k_eff, arms present and finite, no own item borrowed, overall.

    ``borrowed`` is (concept, item_concept). Without any row the gate fails.
    """
    borrow = [c for c in conditions if c != "isolated"]
    k = rows.where(F.col("condition").isin(*borrow)).groupBy(*cell).agg((F.countDistinct("k_eff") <= 1).alias("ok"))
    arms = rows.groupBy(*cell, "level", "draw").agg(
        (F.size(F.array_except(F.array(*[F.lit(c) for c in conditions]), F.collect_set(F.when(F.col("condition").isin(*conditions), F.col("condition"))))) == 0).alias("full"),
        F.bool_and(finite("dino")).alias("fin"))
    clean = borrowed.agg((F.count_if(F.col("concept") == F.col("item_concept")) == 0).alias("no_contamination"))
    a = k.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("k_eff_equal"))
    b = arms.agg(F.coalesce(F.bool_and(F.col("full") & F.col("fin")), F.lit(False)).alias("arms_comparable"))
    out = a.join(F.broadcast(b)).join(F.broadcast(clean))
    return out.withColumn("passed", F.col("k_eff_equal") & F.col("arms_comparable") & F.col("no_contamination"))


# --- names ---------------------------------------------------------------------------

def resolve_names(vocabulary: DataFrame, chosen: DataFrame) -> DataFrame:
    """Resolve concepts against class names given as comma-separated lemmas.

    ``vocabulary`` is (label_id, name), ``chosen`` (concept). A first-lemma match always
    beats a match on another lemma; the lowest id wins and several ids mean ambiguous.
    """
    lemmas = vocabulary.select("label_id", F.posexplode(F.filter(F.transform(F.split("name", ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")).alias("_pos", "lemma"))
    stats = lemmas.groupBy("lemma").agg(
        F.min(F.when(F.col("_pos") == 0, F.col("label_id"))).alias("_first"), F.countDistinct(F.when(F.col("_pos") == 0, F.col("label_id"))).alias("_nf"),
        F.min("label_id").alias("_any"), F.countDistinct("label_id").alias("_na"))
    want = chosen.withColumn("lemma", F.lower(F.trim(F.element_at(F.split("concept", ","), 1))))
    j = want.join(stats, "lemma", "left")
    n = F.when(F.col("_first").isNotNull(), F.col("_nf")).otherwise(F.coalesce("_na", F.lit(0)))
    return j.select("concept", F.coalesce("_first", "_any").alias("label_id"),
                    F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("resolved").alias("status"))


def shortfall(resolved: DataFrame, allow: int) -> DataFrame:
    """Violation when more concepts than allowed did not resolve."""
    n = resolved.agg(F.count_if(F.col("status") == "missing").alias("n"))
    return violation(n.where(F.col("n") > allow), "error", "shortfall", F.lit("names"), F.concat(F.col("n").cast("string"), F.lit(" concepts did not resolve")))
