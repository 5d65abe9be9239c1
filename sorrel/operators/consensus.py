"""Attribute consensus, votes, predictions by family and by neighbour, and pair protocols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.scores import binomial_two_sided, ratio
from sorrel.functions.text import is_visible, norm, says_yes
from sorrel.operators.scan import ordered_scan, tuple_scan
from sorrel.operators.similarity import top_k
from sorrel.session import cut

#: Rows of a task that sorts or groups them, however many rows there are.
ROWS_PER_TASK = 1 << 20


def _dealt(rows: DataFrame, total: int, *columns: str) -> DataFrame:
    """``rows``, of which there are ``total`` at most, in tasks of bounded size by ``columns``."""
    return rows.repartition(1 + total // ROWS_PER_TASK, *columns)


def _value_counts(reads: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    v = reads.where(is_visible("value")).withColumn("value", norm("value"))
    first = [F.min(order).alias("first_seen")] if order else []
    return v.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), *first)


def target_attributes(reads: DataFrame, keys: Sequence[str] = ("concept", "slot"), order: str = "ord") -> DataFrame:
    """Plurality value per key with support, visible count and whether it is a target.

    Reads are (keys, value, order). The value seen first wins a tie. A target has three
    visible reads and support of at least two and half of them.
    """
    c = _value_counts(reads, keys, order)
    best = c.groupBy(*keys).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "first_seen", "value")).alias("_w"), F.sum("n").alias("visible_count"))
    support = -F.col("_w.neg")
    need = F.greatest(F.lit(2), F.ceil(F.col("visible_count") / 2))
    return best.select(*keys, F.col("_w.value").alias("value"), support.alias("support"), "visible_count",
                       ((support >= need) & (F.col("visible_count") >= 3)).alias("is_target"))


def decidable(targets: DataFrame, key: str = "concept") -> DataFrame:
    """Target count per concept and whether it reaches two."""
    return targets.groupBy(key).agg(F.count_if("is_target").alias("n_targets")).withColumn("decidable", F.col("n_targets") >= 2)


def target_bucket(n_targets) -> Column:
    """Target count as a label, five and more together."""
    n = F.col(n_targets) if isinstance(n_targets, str) else n_targets
    return F.when(n <= 4, n.cast("string")).otherwise("5+")


def feasibility(targets: DataFrame, cohorts: DataFrame | None = None, key: str = "concept") -> DataFrame:
    """Decidable and undecidable concepts, overall or by cohort."""
    d = decidable(targets, key)
    if cohorts is not None:
        d = d.join(cohorts, key)
    return d.groupBy(*(["cohort"] if cohorts is not None else [])).agg(
        F.count_if("decidable").alias("n_decidable"), F.count_if(~F.col("decidable")).alias("n_undecidable"))


def strict_majority(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Top value per key when it beats the runner-up; no label on a tie."""
    c = _value_counts(reads, keys, None)
    # the lowest and the highest of the top values are one value unless several are tied
    w = c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("_low"), F.max(F.struct("n", "value")).alias("_high"))
    return w.where(F.col("_low.value") == F.col("_high.value")).select(*keys, F.col("_high.value").alias("value"), F.col("_high.n").alias("votes"))


def heldout_labels(reads: DataFrame, build: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Strict majority over reads of paths outside the build set, each path read once per key.

    Reads pass by a hash table of the build paths and are not sorted for it; what is left is dealt
    to tasks of bounded size by key and path.
    """
    fresh = reads.join(build.select(path).distinct().hint("shuffle_hash"), path, "left_anti")
    once = _dealt(fresh, reads.count(), *keys, path).groupBy(*keys, path).agg(F.min("value").alias("value"))
    return strict_majority(once, keys)


def family_majority(attrs: DataFrame, vectors: DataFrame | None = None, vec: str = "vec") -> DataFrame:
    """Majority value among same-family siblings, per (concept, slot).

    ``attrs`` is one row (concept, family, part, slot, value) per concept and slot. Taking a
    concept's own vote from its family's counts can only touch its own value, so the highest
    and second highest counts of a family tell every member's majority: one row a concept,
    however many values a family has. A tie goes to the tied value of the most similar
    sibling by ``vectors`` (concept, part, unit vector), one exact top-1 among the holders of
    tied values, else to the lowest value.
    """
    known = attrs.where(F.col("family").isNotNull())
    place = ["family", "slot"]
    votes = known.groupBy(*place, "value").agg(F.count(F.lit(1)).alias("_n"))
    first = votes.groupBy(*place).agg(F.max("_n").alias("_n1"))
    leading = cut(votes.join(first, place))
    top, rest = F.col("_n") == F.col("_n1"), F.col("_n") < F.col("_n1")
    stats = leading.groupBy(*place).agg(
        F.first("_n1").alias("_n1"), F.count_if(top).alias("_k1"), F.min(F.when(top, F.col("value"))).alias("_low1"),
        F.max(F.when(rest, F.col("_n"))).alias("_n2"))
    second = leading.join(stats.select(*place, "_n2", "_low1"), place).groupBy(*place).agg(
        F.min(F.when(top & (F.col("value") != F.col("_low1")), F.col("value"))).alias("_next1"),
        F.count_if(F.col("_n") == F.col("_n2")).alias("_k2"), F.min(F.when(F.col("_n") == F.col("_n2"), F.col("value"))).alias("_low2"))
    # a value's class: 1 among the highest counts, 2 among the second highest
    ranked = leading.join(stats.select(*place, "_n2"), place).select(*place, "value", "_n", F.when(top, 1).when(F.col("_n") == F.col("_n2"), 2).alias("_class"))
    mine = known.select("concept", "family", "part", "slot", F.col("value").alias("_own"))
    own = ranked.select(*place, F.col("value").alias("_own"), F.col("_n").alias("_mine"))
    j = mine.join(own, [*place, "_own"]).join(stats, place).join(second, place)
    sole = (F.col("_mine") == F.col("_n1")) & (F.col("_k1") == 1)
    shared = (F.col("_mine") == F.col("_n1")) & (F.col("_k1") > 1)
    level = F.coalesce(F.col("_n1") - 1 == F.col("_n2"), F.lit(False))
    per = j.where(~(sole & (F.col("_n1") == 1) & F.col("_n2").isNull())).select(
        "concept", "family", "part", "slot", "_own", (sole & level).alias("_second"),
        F.when(sole, F.when(level, F.col("_k2") + 1).otherwise(1)).when(shared, F.col("_k1") - 1).otherwise(F.col("_k1")).alias("_k"),
        F.when(sole, F.when(level, F.least("_own", "_low2")).otherwise(F.col("_own"))).when(
            shared & (F.col("_own") == F.col("_low1")), F.col("_next1")).otherwise(F.col("_low1")).alias("_low"))
    if vectors is None:
        return per.select("concept", "slot", F.col("_low").alias("prediction"))
    per = cut(per)
    key = lambda *c: F.concat_ws("\u0001", *[F.col(x).cast("string") for x in c])
    # the own value is out among equals; where it is level with the second only the own row is
    mode = lambda second, value: F.when(second, F.struct(F.lit("level").alias("m"), F.col("concept").cast("string").alias("t"))).otherwise(
        F.struct(F.lit("equal").alias("m"), F.col(value).cast("string").alias("t")))
    asks = per.where(F.col("_k") > 1).withColumn("_mode", mode(F.col("_second"), "_own")).join(vectors, ["concept", "part"]).select(
        key("concept", "slot").alias("query_id"), key(*place, "_mode.m").alias("_grp"), F.col("_mode.t").alias("_tag"), "concept", "slot", F.col(vec).alias("vec"))
    holders = known.join(ranked.where(F.col("_class").isNotNull()).select(*place, "value", "_class"), [*place, "value"]).withColumn(
        "_mode", F.explode(F.filter(F.array(F.when(F.col("_class") == 1, mode(F.lit(False), "value")), mode(F.lit(True), "value")), lambda m: m.isNotNull())))
    holders = holders.join(vectors, ["concept", "part"]).select(
        F.col("concept").alias("doc_id"), key(*place, "_mode.m").alias("_grp"), F.col("_mode.t").alias("_tag"), F.col(vec).alias("vec"))
    near = top_k(asks, holders, 1, tag="_tag", group="_grp").select("query_id", "doc_id")
    won = asks.select("query_id", "concept", "slot").join(near, "query_id").join(
        known.select(F.col("concept").alias("doc_id"), "slot", F.col("value").alias("_near")), ["doc_id", "slot"])
    return per.join(won.select("concept", "slot", "_near"), ["concept", "slot"], "left").select("concept", "slot", F.when(
        F.col("_k") == 1, F.col("_low")).otherwise(F.coalesce("_near", "_low")).alias("prediction"))


def neighbour_prediction(vectors: DataFrame, attrs: DataFrame, vec: str = "vec") -> DataFrame:
    """Value of the most similar other concept that has the slot, per (concept, slot).

    ``vectors`` has one unit vector per (concept, part); a slot belongs to a part. The
    search is a grouped top-1 over concepts having the slot.
    """
    have = attrs.join(vectors, ["concept", "part"]).select(
        F.col("concept").alias("doc_id"), "slot", "value", F.col(vec).alias("vec"), F.col("concept").alias("_tag"))
    slots = attrs.select("part", "slot").distinct()
    asks = vectors.join(slots, "part").select(F.concat_ws("\u0001", F.col("concept").cast("string"), "slot").alias("query_id"),
                                              "slot", F.col(vec).alias("vec"), F.col("concept").alias("_tag"), "concept")
    hits = top_k(asks, have, 1, tag="_tag", group="slot").select("query_id", F.col("doc_id").alias("_doc"))
    won = asks.select("query_id", "concept", "slot").join(hits, "query_id")
    return won.join(attrs.select(F.col("concept").alias("_doc"), "slot", F.col("value").alias("prediction")), ["_doc", "slot"]).select("concept", "slot", "prediction")


def rare_values(labels: DataFrame) -> DataFrame:
    """Values of each slot held by at most max(2, 15 %) of the concepts labelled for it."""
    c = labels.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    total = labels.groupBy("slot").agg(F.count(F.lit(1)).alias("n_visible"))
    return c.join(total, "slot").where(F.col("n") <= F.greatest(F.lit(2), F.ceil(F.col("n_visible") * F.lit(0.15)))).select("slot", "value", "n", "n_visible")


def two_arm_cases(labels: DataFrame, a: DataFrame, b: DataFrame, names: tuple[str, str] = ("retrieval", "graph")) -> DataFrame:
    """Cases where both arms predict, with the label and whether it is rare."""
    keys = ["concept", "slot"]
    rare = rare_values(labels).select("slot", "value", F.lit(True).alias("rare"))
    j = labels.join(a.withColumnRenamed("prediction", f"pred_{names[0]}"), keys).join(b.withColumnRenamed("prediction", f"pred_{names[1]}"), keys)
    return j.join(rare, ["slot", "value"], "left").withColumn("rare", F.coalesce("rare", F.lit(False)))


def two_arm_report(scored: DataFrame) -> DataFrame:
    """Recalls per rarity, rare delta, exact discordance test and decision, from match_a and match_b flags."""
    rare, a, b = F.col("rare"), F.col("match_retrieval"), F.col("match_graph")
    nan = float("nan")
    rec = lambda m, r: ratio(F.count_if(r & m), F.count_if(r), nan)
    s = scored.agg(
        F.count_if(rare).alias("n_rare"), F.count(F.lit(1)).alias("n_total"),
        rec(b, rare).alias("rare_recall_graph"), rec(a, rare).alias("rare_recall_retrieval"),
        rec(b, ~rare).alias("common_recall_graph"), rec(a, ~rare).alias("common_recall_retrieval"),
        F.count_if(rare & b & ~a).alias("graph_only"), F.count_if(rare & a & ~b).alias("retrieval_only"))
    s = s.withColumn("delta", F.col("rare_recall_graph") - F.col("rare_recall_retrieval")).withColumn("mcnemar_p", binomial_two_sided("graph_only", "retrieval_only"))
    ok = ~F.isnan("delta") & (F.col("delta") >= 0.15) & (F.col("n_rare") >= 30) & (F.col("mcnemar_p") < 0.05)
    return s.withColumn("decision", F.when(ok, "PASS").otherwise("WIND_DOWN"))


def rare_feasibility(cases: DataFrame) -> DataFrame:
    """Included and rare cases per slot and in all (slot NULL)."""
    return cases.groupingSets([[], [F.col("slot")]], "slot").agg(
        F.count(F.lit(1)).alias("n_included"), F.count_if("rare").alias("n_rare"))


# --- attribute verdicts ----------------------------------------------------------------

def judge_both_ways(replies: DataFrame) -> DataFrame:
    """Agreement of (x, y, slot, reply): both orders must say yes; hidden sides never match."""
    r = replies.groupBy("x", "y", "slot").agg(F.max(says_yes("reply")).alias("yes"))
    back = r.select(F.col("y").alias("x"), F.col("x").alias("y"), "slot", F.col("yes").alias("_back"))
    return r.join(back, ["x", "y", "slot"], "left").select(
        "x", "y", "slot", (is_visible("x") & is_visible("y") & F.col("yes") & F.coalesce("_back", F.lit(False))).alias("match"))


def attribute_states(targets: DataFrame, reads: DataFrame, judged: DataFrame, case: Sequence[str] = ("case_id",)) -> DataFrame:
    """State of each target slot of a case: present, match, contradicted.

    ``targets`` is (case, slot, value, is_target), ``reads`` (case, slot, value), ``judged``
    (x, y, slot, match); an unjudged pair does not match.
    """
    t = targets.where("is_target").select(*case, "slot", F.col("value").alias("target"))
    r = reads.select(*case, "slot", F.col("value").alias("read"))
    j = t.join(r, [*case, "slot"], "left").withColumn("read", F.coalesce("read", F.lit("not visible")))
    j = j.withColumn("_norm", norm("read")).join(
        judged.select(F.col("x").alias("target"), F.col("y").alias("_norm"), "slot", "match"), ["target", "_norm", "slot"], "left")
    present = is_visible("read")
    match = F.when(~present, F.lit(None).cast("boolean")).when(F.col("target") == F.col("_norm"), True).otherwise(F.coalesce("match", F.lit(False)))
    return j.select(*case, "slot", "target", "read", present.alias("present"), match.alias("match"), (present & ~F.coalesce(match, F.lit(True))).alias("contradicted"))


def case_verdicts(cases: DataFrame, states: DataFrame, n_targets: str = "n_targets", case: Sequence[str] = ("case_id",)) -> DataFrame:
    """ABSTAIN when undecidable or nothing is present, FAIL on any contradiction, else PASS."""
    s = states.groupBy(*case).agg(F.count_if("present").alias("n_present"), F.count_if("contradicted").alias("n_contradicted"))
    j = cases.join(s, list(case), "left").fillna(0, ["n_present", "n_contradicted"])
    return j.withColumn("verdict", F.when((F.col(n_targets) < 2) | (F.col("n_present") == 0), "ABSTAIN").when(
        F.col("n_contradicted") > 0, "FAIL").otherwise("PASS"))


def nearest_siblings(species: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` same-family species nearest by id distance, as (id, sibling, rank from 1).

    Ordered by id, the k nearest lie among the k positions before and the k after. Positions
    come from a range-wise scan and neighbours from an equality join on (family, position),
    so a family of any size neither pairs up nor sits in one task. Ties go to the lower id.
    """
    known = species.where(F.col("family").isNotNull()).select("id", "family", F.col("id").cast("double").alias("_o"))
    placed = ordered_scan(known, ["family"], "_o", ["id"], {"_pos": ("sum", F.lit(1), "upto")})
    offsets = F.array(*[F.lit(i) for i in range(-k, k + 1) if i])
    asks = placed.select("id", "family", F.explode(F.transform(offsets, lambda o: F.col("_pos") + o)).alias("_pos"))
    near = asks.join(placed.select("family", "_pos", F.col("id").alias("sibling")), ["family", "_pos"])
    # at most 2k neighbours per id
    per = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.abs(F.col("sibling") - F.col("id")).alias("d"), "sibling"))).alias("_n"))
    return per.select("id", F.posexplode(F.slice("_n", 1, k)).alias("rank", "_s")).select("id", F.col("_s.sibling").alias("sibling"), (F.col("rank") + 1).alias("rank"))


def discrimination_pairs(tests: DataFrame, siblings: DataFrame, profiles: DataFrame) -> DataFrame:
    """SAME and SIBLING pairs of test items of decidable species, (item, id, candidate, label)."""
    t = tests.join(profiles.where("decidable").select("id"), "id", "left_semi")
    same = t.select("item", "id", F.col("id").alias("candidate"), F.lit("pass").alias("label"))
    sib = t.join(siblings, "id").select("item", "id", F.col("sibling").alias("candidate"), F.lit("fail").alias("label"))
    return same.unionByName(sib)


def whole_families(species: DataFrame, min_family: int = 3, min_species: int = 24) -> DataFrame:
    """Species of whole families, smallest families first, until enough species are taken."""
    size = species.where(F.col("family").isNotNull()).groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_family)
    run = tuple_scan(size, [], ["n", "family"], {"_before": ("sum", "n", "before")})
    taken = run.where(F.coalesce("_before", F.lit(0)) < min_species).select("family")
    return species.join(taken, "family", "left_semi")


# --- hit tables ---------------------------------------------------------------------------

def both_arms(flat: DataFrame, graph: DataFrame) -> DataFrame:
    """(concept, path, _fs, _gs): the best score of each path of a concept in either arm, null where an arm lacks it.

    A row with a null concept or path is in one arm only.
    """
    none = lambda df: F.lit(None).cast(df.schema["score"].dataType)
    rows = flat.select("concept", "path", F.col("score").alias("_fs"), none(graph).alias("_gs"), F.lit(True).alias("_flat")).unionByName(
        graph.select("concept", "path", none(flat).alias("_fs"), F.col("score").alias("_gs"), F.lit(False).alias("_flat")))
    rows = _dealt(rows, rows.count(), "concept", "path")
    apart = F.when(F.col("concept").isNull() | F.col("path").isNull(), F.col("_flat"))
    return rows.groupBy("concept", "path", apart.alias("_apart")).agg(F.max("_fs").alias("_fs"), F.max("_gs").alias("_gs")).drop("_apart")


def arm_divergence(flat: DataFrame, graph: DataFrame) -> DataFrame:
    """Per concept: pool sizes, Jaccard, same top reference, part types covered, flat top in the graph pool.

    ``flat`` is (concept, path, score), ``graph`` adds part_type.
    """
    both = both_arms(flat, graph)
    top = lambda s: F.min_by("path", F.when(F.col(s).isNotNull(), F.struct(-F.col(s), F.col("path"))))
    inter, union = F.count_if(F.col("_fs").isNotNull() & F.col("_gs").isNotNull()), F.count(F.lit(1))
    per = both.groupBy("concept").agg(
        F.count("_fs").alias("n_flat"), F.count("_gs").alias("n_graph"), ratio(inter, union).alias("jaccard"),
        top("_fs").alias("_ft"), top("_gs").alias("_gt"),
        F.min_by(F.col("_gs").isNotNull(), F.when(F.col("_fs").isNotNull(), F.struct(-F.col("_fs"), F.col("path")))).alias("flat_top_in_graph"))
    parts = graph.groupBy("concept").agg(F.countDistinct("part_type").alias("n_part_types"))
    return per.join(parts, "concept", "left").select(
        "concept", "n_flat", "n_graph", "jaccard", F.coalesce(F.col("_ft") == F.col("_gt"), F.lit(False)).alias("same_top"),
        F.coalesce("n_part_types", F.lit(0)).alias("n_part_types"), F.coalesce("flat_top_in_graph", F.lit(False)).alias("flat_top_in_graph"))


def part_representatives(graph: DataFrame) -> DataFrame:
    """Best-scored item per concept and part type."""
    return graph.groupBy("concept", "part_type").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"), F.max("score").alias("score"))


def checklist_accuracy(yes: Column | str) -> Column:
    """Aggregate: share of yes answers, 1 when there are none to ask."""
    c = F.col(yes) if isinstance(yes, str) else yes
    return F.coalesce(F.avg(c.cast("int")), F.lit(1.0))
