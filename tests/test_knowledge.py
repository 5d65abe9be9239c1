"""Consensus, guards, text, sources, store and adapters on small fixtures."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel import udf
from sorrel.functions import names, text
from sorrel.functions.scores import binomial_two_sided, wilson
from sorrel.operators import consensus, corpus, guards, matrix, paired, verdicts
from sorrel.plans import studies
from sorrel.sources import files, graphs, store


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_consensus_thresholds_and_first_seen_tie(spark):
    rows = [("a", "s", i, v) for i, v in enumerate(["Red", " red", "blue", "not visible"])] + [("b", "s", i, v) for i, v in enumerate(["x", "y"])]
    got = {r.concept: r for r in consensus.target_attributes(spark.createDataFrame(rows, "concept string, slot string, ord long, value string")).collect()}
    assert (got["a"].value, got["a"].support, got["a"].visible_count, got["a"].is_target) == ("red", 2, 3, True)
    assert (got["b"].value, got["b"].is_target) == ("x", False)


def test_heldout_vote_counts_a_path_once_and_needs_a_winner(spark):
    reads = spark.createDataFrame([("c", "p1", "red"), ("c", "p1", "red"), ("c", "p2", "blue"), ("c", "b", "red")], "concept string, path string, value string")
    build = spark.createDataFrame([("b",)], "path string")
    assert consensus.heldout_labels(reads, build, ["concept"]).count() == 0
    more = reads.unionByName(spark.createDataFrame([("c", "p3", "Red ")], reads.schema))
    assert consensus.heldout_labels(more, build, ["concept"]).first().value == "red"


def test_rarity_threshold(spark):
    rows = [(f"c{i}", "s", "common" if i > 2 else "rare3") for i in range(20)]
    got = {r.value for r in consensus.rare_values(spark.createDataFrame(rows, "concept string, slot string, value string")).collect()}
    assert got == {"rare3"}


def test_case_verdicts(spark):
    targets = spark.createDataFrame([(1, "a", "red", True), (1, "b", "big", True), (1, "c", "x", False)], "case_id long, slot string, value string, is_target boolean")
    judged = spark.createDataFrame([("red", "crimson", "a", True)], "x string, y string, slot string, match boolean")
    cases = spark.createDataFrame([(1, 2)], "case_id long, n_targets long")
    def verdict(**read):
        reads = spark.createDataFrame([(1, k, v) for k, v in read.items()], "case_id long, slot string, value string")
        return consensus.case_verdicts(cases, consensus.attribute_states(targets, reads, judged)).first().verdict
    assert verdict(a="Red", b="not visible") == "PASS"
    assert verdict(a="crimson") == "PASS"
    assert verdict(a="blue", b="big") == "FAIL"
    assert verdict(c="x") == "ABSTAIN"


def test_exact_tests_and_intervals(spark):
    assert one(spark, binomial_two_sided(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, binomial_two_sided(F.lit(1), F.lit(6))) == pytest.approx(2 * (1 + 7) / 2 ** 7)
    assert one(spark, binomial_two_sided(F.lit(3), F.lit(3))) == 1.0
    lo, hi = wilson(F.lit(0), F.lit(0))
    assert (one(spark, lo), one(spark, hi)) == (0.0, 1.0)


def test_false_positive_boundary(spark):
    def rate(fp):
        rows = [("FAIL" if i < fp else "PASS", "pass") for i in range(24)] + [("FAIL", "fail")] * 3 + [("ABSTAIN", "fail")]
        return verdicts.three_way_confusion(spark.createDataFrame(rows, "verdict string, label string")).first()
    two, three = rate(2), rate(3)
    assert two.fp_rate <= 2 / 24 < three.fp_rate and two.recall == 0.75 and two.n_abstain == 1
    none = verdicts.three_way_confusion(spark.createDataFrame([("PASS", "pass")], "verdict string, label string")).first()
    assert none.recall != none.recall and none.mcc == 0.0


def test_winner_rules(spark):
    rows = [(1, 0, True, 0.1), (1, 1, True, 0.9), (2, 0, False, 0.5), (2, 1, False, 0.9), (2, 2, True, 0.1), (3, 0, False, 0.5), (3, 1, False, 0.5), (3, 2, False, None),
            (4, 0, False, None), (4, 1, False, 0.1), (5, 0, False, None), (5, 1, False, None)]
    got = {r.case_id: r.winner for r in verdicts.select_winner(spark.createDataFrame(rows, "case_id long, attempt long, ok boolean, score double")).collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: 1, 5: 0}


def test_route_rejects_non_finite_scores(spark):
    df = spark.createDataFrame([(True, float("nan"), 0.1)], "ok boolean, t double, r double")
    with pytest.raises(Exception, match="non-finite"):
        df.select(verdicts.route_guarded("ok", "t", "r", 0.5, 0.5)).collect()


def test_gates_are_three_valued(spark):
    df = spark.createDataFrame([(0.8, None)], "a double, b double")
    g = verdicts.gate_table(df, [("a", "a", ">=", 0.8), ("b", "b", ">", 0.0)])
    assert verdicts.readiness(g).first().readiness == "INCONCLUSIVE"
    assert verdicts.readiness(verdicts.gate_table(df, [("a", "a", ">", 0.8), ("b", "b", ">", 0.0)])).first().readiness == "FAIL"


def test_failed_routed_attempt_stops_the_study(spark):
    df = spark.createDataFrame([("c", "rare", True, False, "d", "a")], "case_id string, cohort string, routed boolean, attempt_ok boolean, draft_path string, attempt_path string")
    with pytest.raises(Exception, match="routed attempt failed"):
        verdicts.assemble_arms(df).collect()


def test_confidence_chooses_the_margin(spark):
    df = spark.createDataFrame([([(0.9, None, 0.1), (0.8, 0.7, 0.2), (0.8, 0.1, 0.9)],)], "c array<struct<dino_conf double, sim_proto double, sim_proto_coarse double>>")
    assert df.select(verdicts.prototype_margin("c").alias("m")).first().m == pytest.approx(0.5)


def test_states_round_before_comparing(spark):
    assert one(spark, verdicts.state_at(F.lit(0.60), F.lit(0.60) - F.lit(0.50), 0.25, 0.1)) == "PRESENT"
    assert one(spark, verdicts.state_at(F.lit(None).cast("double"), F.lit(0.0), 0.25, 0.1)) == "ABSTAIN"


# --- text -----------------------------------------------------------------------------------------

def test_phrases_are_word_bounded(spark):
    caps = spark.createDataFrame([(1, "A foxglove and a Fox"), (2, "red   fox, den"), (3, "red. fox"), (4, "café fox_1"), (5, "St. John's wort!")], "id long, text string")
    want = {"fox": {1, 2, 3}, "red fox": {2}, "foxglove": {1}, "St. John's": {5}, "none": set()}
    concepts = spark.createDataFrame([(c,) for c in want], "concept string")
    got = {c: set() for c in want}
    for r in corpus.phrase_matches(caps, concepts, "id").collect():
        got[r.concept].add(r.id)
    assert got == want
    rx = {r.concept: r.n for r in caps.join(concepts, text.mentions("text", "concept")).groupBy("concept").agg(F.count("*").alias("n")).collect()}
    assert rx == {c: len(v) for c, v in want.items() if v}
    assert {r.concept: r.n for r in corpus.caption_counts(caps, concepts, "id").collect()}["none"] == 0


def test_vague_values(spark):
    df = spark.createDataFrame([("a", " Green "), ("a", "deep  red veins"), ("b", "not visible"), ("b", "lobed leaf edge"), ("c", "n/a")], "k string, v string")
    got = {r.k: r.x for r in df.groupBy("k").agg(text.should_reask("v").alias("x")).collect()}
    assert got == {"a": True, "b": False, "c": False}
    assert one(spark, text.is_generic(F.lit("leafy")))


def test_prompt_tags(spark):
    tags = one(spark, text.prompt_tags(F.lit("Three foxes next to 2 trees, 2 behind"), F.lit("fox")))
    assert [(t.kind, t.phrase) for t in tags] == [("subject", "fox"), ("count", "three"), ("count", "2"), ("relation", "behind"), ("relation", "next to")]


def test_replies(spark):
    rows = ['{"verdict": "PASS", "issues": []}', 'a {"verdict": "fail", "issues": [{"concept": "x"}]} tail :}', '{"verdict": "PASS", "issues": [{"concept": "x"}]}', "!!!! {}", "[1]", '{"verdict": "MAYBE"}', ""]
    got = [(r.v.ok, r.v.degenerate, r.v.issues) for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").coalesce(1).select(text.judge_reply("t").alias("v")).collect()]
    assert got == [(True, False, []), (False, False, ["x"]), (False, True, []), (False, True, []), (False, True, []), (False, True, []), (False, True, [])]


def test_evidence_state_domain(spark):
    ok = spark.createDataFrame([('{"phrase": "p", "sim": 0.5}',), ('"MISSING"',)], "j string").select(text.score_from_json("j").alias("s")).collect()
    assert [r.s.state for r in ok] == ["ABSTAIN", "MISSING"]
    with pytest.raises(Exception, match="not a verifier state"):
        spark.createDataFrame([('"WRONG"',)], "j string").select(text.score_from_json("j")).collect()


def test_prompt_order_is_stable(spark):
    g = spark.createDataFrame([("c", [("h", "tall", "text"), ("w", "wide", "vision")], [("leaf", [("edge", "smooth", None), ("tip", "sharp", "vision")])])],
                              "concept string, global_attrs array<struct<name:string,value:string,source:string>>, parts array<struct<name:string,attributes:array<struct<name:string,value:string,source:string>>>>")
    got = g.select(names.compose_prompt("concept", names.attribute_phrases("global_attrs", "parts")).alias("p")).first().p
    assert got == "a photo of a plant, w: wide, h: tall, leaf tip: sharp, leaf edge: smooth"


# --- sources -----------------------------------------------------------------------------------------

def test_folder_sidecars_and_lines(spark, tmp_path):
    for cls in ("a", "b"):
        os.makedirs(tmp_path / "img" / cls)
        for i in range(2):
            (tmp_path / "img" / cls / f"{cls}{i}.jpg").write_bytes(b"same" if cls == "a" else bytes([i]))
    (tmp_path / "img" / "a" / "a0.json").write_text('{"caption": "hi"}')
    (tmp_path / "img" / "a" / "a1.json").write_text("{broken")
    f = files.image_folder(spark, str(tmp_path / "img"), content=True)
    kept = guards.content_dedup(f, ["class"], "digest", "path")
    assert sorted(r["class"] for r in kept.collect()) == ["a", "b", "b"]
    assert {r["class"]: r.n_files for r in files.image_classes(spark, str(tmp_path / "img")).collect()} == {"a": 2, "b": 2}
    side = files.caption_sidecars(spark, str(tmp_path / "img"))
    assert corpus.caption_files(f, side).first().asDict() == {"n_images": 4, "n_captioned": 1}
    (tmp_path / "classes.txt").write_text("1 001.Black_footed Albatross\n\n2 x\n")
    got = files.keyed_lines(spark, str(tmp_path / "classes.txt"), "name").orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == [(1, "001.Black_footed Albatross"), (2, "x")]
    assert one(spark, names.common_name(F.lit("001.Black_footed_Albatross"))) == "Black footed Albatross"


def test_csv_keeps_exact_species(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_name;organ;species\n1;leaf;Acer rubrum\n2;bark;Acer rubrum L.\n3;leaf;Acer rubrum;extra;cells\n")
    want = spark.createDataFrame([("Acer rubrum",)], "species string")
    got = files.species_csv(spark, str(tmp_path / "m.csv"), "image_name string, organ string, species string", want).collect()
    assert [r.image_name for r in got] == ["1"]


def test_graph_files(spark, tmp_path):
    doc = {"concept": "c", "global_attrs": [], "parts": [{"name": "leaf", "attributes": [{"name": "edge", "value": " Smooth ", "source": "vision"}, {"name": "tip", "value": "Not visible"}],
           "exemplar_crop": "x", "embeddings": {"siglip2": [3.0, 4.0]}}, {"name": "bark", "attributes": [], "exemplar_crop": None, "embeddings": {"siglip2": []}}],
           "anchor": "", "delta": [], "ref_paths": ["a"], "ref_embeddings": [[1.0]]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    g = graphs.read_graphs(spark, str(tmp_path / "*.json"))
    assert [(r.part, r.vec) for r in graphs.part_exemplars(g).collect()] == [("leaf", [0.6, 0.8])]
    assert [(r.attr, r.value) for r in graphs.visible_attributes(g).collect()] == [("edge", "smooth")]
    assert g.select(guards.usable_records().alias("u")).first().u
    (tmp_path / "i1.txt").write_text('[{"id": "c::leaf::0", "concept": "c", "part": "leaf", "siglip2": [1, 0]}]')
    (tmp_path / "i2.txt").write_text('{"a": 1}')
    assert [r.id for r in graphs.read_part_instances(spark, str(tmp_path / "i*.txt")).collect()] == ["c::leaf::0"]


def test_manifest_types(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"eligible": ["x", "y"]}, "b": {"eligible": "x"}, "c": {"eligible": [], "eval_set": 3}}')
    got = {r.key: (r.eligible, r.valid) for r in files.species_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got["a"] == (["x", "y"], True) and not got["b"][1] and not got["c"][1]


def test_crop_boxes_shift_inside_the_frame(spark):
    pts = spark.createDataFrame([(1, "beak", 2.0, 50.0, True), (1, "crown", 4.0, 50.0, True), (1, "back", 5.0, 5.0, False)], "image_id long, part string, x double, y double, visible boolean")
    boxes = spark.createDataFrame([(1, 100.0, 50.0, 200, 40)], "image_id long, box_w double, box_h double, width int, height int")
    got = files.group_crops(files.with_part_group(pts), boxes).collect()
    # 45 % of 100 is 45; the frame is 40 high, so the full height is used
    assert [(r.part_group, r.x0, r.y0, r.x1, r.y1) for r in got] == [("head", 0, 0, 45, 40)]


def test_store_filters_and_stamp(spark, tmp_path):
    species = spark.createDataFrame([("d:a",), ("d:b",), ("d:none",)], "global_id string").withColumn("taxonomy", F.create_map(F.lit("family"), F.lit("f")))
    items = spark.createDataFrame([("d:a", 1, "p1", "leaf", 1, [1.0, 0.0]), ("d:a", 2, "p2", "leaf", 2, [0.9, 0.1]), ("d:b", 3, "p3", "bark", 1, [0.0, 1.0])],
                                  "global_id string, ref long, path string, part string, ord long, vec array<double>")
    attrs = spark.createDataFrame([("d:a", "color", "red", 3, 4, "s"), ("d:none", "color", "red", 1, 1, "s")], "global_id string, slot string, value string, support int, visible_count int, source string")
    rel = spark.createDataFrame([("d:a", "instance_of", "h1"), ("d:b", "instance_of", "h1")], "global_id string, type string, target string")
    t = store.build_records(species, items, attrs, rel)
    assert [r.global_id for r in t["skipped"].collect()] == ["d:none"]
    store.write_store(t, str(tmp_path / "s"), "enc", 2)
    s = store.read_store(spark, str(tmp_path / "s"), "enc", 2)
    ids = lambda **f: sorted(r.global_id for r in store.lookup(s["posting"], s["record"], **f).collect())
    assert ids() == ["d:a", "d:b"] and ids(hub="h1") == ["d:a", "d:b"] and ids(hub="h1", attribute=("color", "red")) == ["d:a"] and ids(part_type="bark") == ["d:b"] and ids(hub="h1", attribute=("color", "red"), part_type="bark") == []
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vec array<double>")
    assert [r.ref for r in store.nearest_crops(s, q, 2, part_type="leaf").collect()] == [1]
    with pytest.raises(ValueError):
        store.read_store(spark, str(tmp_path / "s"), "other", 2)


# --- guards ------------------------------------------------------------------------------------------

def test_path_containment_is_by_component(spark):
    refs = spark.createDataFrame([("/corpus/a/x.png",), ("/corpus2/a.png",), ("/corpus",)], "path string")
    roots = spark.createDataFrame([("/corpus/",)], "root string")
    assert sorted(r.path for r in guards.path_leaks(refs, roots).collect()) == ["/corpus", "/corpus/a/x.png"]


def test_first_lemma_wins(spark):
    voc = spark.createDataFrame([(0, "beacon, lighthouse"), (1, "crane, machine"), (2, "crane"), (3, "lighthouse keeper, beacon")], "label_id long, name string")
    got = {r.concept: (r.label_id, r.status) for r in guards.resolve_names(voc, spark.createDataFrame([("Lighthouse",), ("crane",), ("beacon",), ("fox",)], "concept string")).collect()}
    assert got == {"Lighthouse": (0, "resolved"), "crane": (1, "ambiguous"), "beacon": (0, "resolved"), "fox": (None, "missing")}


def test_enforce_names_the_case(spark):
    labels = spark.createDataFrame([("c1", "pass"), ("c2", "odd")], "case_id string, verdict string")
    with pytest.raises(ValueError, match="bad_verdict"):
        guards.enforce(guards.label_domain(labels, "verdict"))
    with pytest.raises(Exception, match="c2"):
        verdicts.ground_truth(labels, "verdict")[0].collect()


def test_empty_run_fails_its_gate(spark):
    rows = spark.createDataFrame([], "concept string, part string, level long, draw long, condition string, k_eff long, dino double")
    borrowed = spark.createDataFrame([], "concept string, item_concept string")
    assert not guards.run_sanity(rows, borrowed, ["isolated", "hub"]).first().passed


def test_matrix_shapes(spark):
    plan = matrix.run_matrix(spark.createDataFrame([("s",)], "species string"), ["ours", "b0"], ["named"], [0.4, 0.8], 2)
    assert plan.count() == 6 and plan.where("ip_scale IS NULL").count() == 2
    assert plan.where("method = 'b0'").orderBy("seed").first().image_id == "s|b0|named|ipNone|seed0"


def test_paired_matrix_fixture(spark):
    rows = [("a", "ours", 0.50), ("a", "b1", 0.40), ("b", "ours", 0.30), ("b", "b1", 0.45), ("c", "ours", 0.9)]
    df = spark.createDataFrame(rows, "species string, method string, dino double").withColumn("ord", F.monotonically_increasing_id())
    s = paired.paired_summary(paired.paired_units(df, ["species"], "method", "dino", "ours", "b1", "ord")).first()
    assert (s.n, s.win_rate) == (2, 0.5) and s.mean_delta == pytest.approx(-0.025)
    empty = paired.paired_summary(paired.paired_units(df.where("method = 'b1'"), ["species"], "method", "dino", "ours", "b1", "ord")).first()
    assert (empty.n, empty.mean_delta, empty.win_rate) == (0, None, None)


def test_holdout_reports_short_cohorts(spark):
    cand = spark.createDataFrame([(1, "a", "rare", "FAIL", True, False), (2, "b", "control", "PASS", True, True)], "ord long, case_id string, cohort string, identity_truth string, eligible boolean, contaminated boolean")
    refs = spark.createDataFrame([("a", "p")], "case_id string, path string")
    h = studies.holdout(cand, refs, refs, 1)
    assert sorted((r.code, r.ident) for r in h["problems"].collect()) == [("reference_in_reserve", "a"), ("short_cohort", "control")]


# --- adapters -----------------------------------------------------------------------------------------

def test_adapters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id long, t string")
    got = {r.id: r.vec for r in udf.embed_items(df, "id", "t", lambda xs: np.array([[3.0, 4.0]] * len(xs)), 2).collect()}
    assert got[1] == [0.6, 0.8]
    with pytest.raises(Exception, match="expected"):
        udf.embed_items(df, "id", "t", lambda xs: np.zeros((len(xs), 3)), 2).collect()
    out = udf.map_distinct(df.unionByName(df), ["t"], lambda xs: [len(x) if x else -1 for x in xs], "n", T.LongType()).collect()
    assert sorted((r.id, r.n) for r in out) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, -1), (3, -1)]
