"""Run matrices and file sources: data is written from the tables by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.catalog.base import big, items, literal_rows, query, r, table
from sorrel.functions import names
from sorrel.functions.vectors import dot
from sorrel.operators import guards, matrix, sampling, selection
from sorrel.session import cut, scratch_path
from sorrel.sources import files, graphs

# --- run matrix: species = nation, scores = line item sums -----------------------------------

_PLAN = """plan AS (SELECT n_name AS species, m.method, md.name_mode, CASE WHEN m.method IN ('ours', 'ours_notree', 'b1') THEN s.scale END AS ip_scale, sd.seed FROM nation,
 (VALUES ('ours'), ('b0'), ('b1')) m(method), (VALUES ('named'), ('neutral')) md(name_mode), (VALUES (0.4::DOUBLE), (0.6::DOUBLE)) s(scale), (VALUES (0), (1), (2)) sd(seed) WHERE m.method <> 'b0' OR s.scale = 0.4),
pl AS (SELECT species || '|' || method || '|' || name_mode || '|ip' || coalesce(ip_scale::VARCHAR, 'None') || '|seed' || seed AS image_id, * FROM plan)"""


def plan(spark, sf):
    species = table(spark, sf, "nation").select(F.col("n_name").alias("species"))
    return matrix.run_matrix(species, ["ours", "b0", "b1"], ["named", "neutral"], [0.4, 0.6], 3)


@query("run_matrix", f"WITH {_PLAN} SELECT image_id, species, method, name_mode, ip_scale, seed FROM pl")
def run_matrix(spark, sf):
    return plan(spark, sf)


_KEYS = "h AS (SELECT image_id, (ascii(substr(md5(image_id), 1, 1)) * 31 + ascii(substr(md5(image_id), 2, 1)) * 7 + ascii(substr(md5(image_id), 3, 1))) % 800 AS slot FROM pl), k AS (SELECT * FROM h WHERE slot % 3 <> 0)"
_SCORES = f"""{_PLAN}, {_KEYS}, sums AS (SELECT (l_orderkey * 7 + l_linenumber) % 800 AS slot, sum(l_quantity) % 97 / 97.0 AS dino, sum(l_extendedprice * 100)::BIGINT % 89 / 89.0 AS siglip2, count(*) % 7 / 7.0 AS attribute_accuracy FROM lineitem GROUP BY 1),
sc AS (SELECT image_id, dino, CASE WHEN slot % 5 = 0 THEN NULL ELSE siglip2 END AS siglip2, attribute_accuracy FROM k JOIN sums USING (slot))"""


def scores(spark, sf):
    """Scores of the runs a hash of their id reaches; some runs stay without any."""
    h = F.md5("image_id")
    at = lambda i: F.ascii(F.substring(h, i, 1))
    slot = plan(spark, sf).select("image_id", ((at(1) * 31 + at(2) * 7 + at(3)) % 800).alias("slot")).where("slot % 3 <> 0")
    li = table(spark, sf, "lineitem")
    sums = li.groupBy(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 800).alias("slot")).agg(
        (F.sum("l_quantity") % 97 / 97).alias("dino"), (F.round(F.sum(F.col("l_extendedprice") * 100)).cast("long") % 89 / 89).alias("siglip2"), (F.count(F.lit(1)) % 7 / 7).alias("attribute_accuracy"))
    return slot.join(sums, "slot").select("image_id", "dino", F.when(F.col("slot") % 5 != 0, F.col("siglip2")).alias("siglip2"), "attribute_accuracy")


@query("merge_score_tables", f"""WITH {_SCORES} SELECT image_id, round(CASE WHEN image_id LIKE '%seed1' THEN 0.5 ELSE dino END, 9) AS dino, round(siglip2, 9) AS siglip2, round(attribute_accuracy, 9) AS attribute_accuracy FROM sc""")
def merge_score_tables(spark, sf):
    s = cut(scores(spark, sf))
    first = s.select("image_id", "dino", "attribute_accuracy")
    later = s.select("image_id", "siglip2", F.when(F.col("image_id").endswith("seed1"), 0.5).alias("dino"))
    m = matrix.merge_tables([first, later])
    return m.select("image_id", *[r(c, 9).alias(c) for c in ("dino", "siglip2", "attribute_accuracy")])


_BESTSEED = f"""{_SCORES}, ok AS (SELECT pl.*, dino, siglip2, attribute_accuracy FROM pl LEFT JOIN sc USING (image_id)), good AS (SELECT * FROM ok WHERE dino IS NOT NULL AND siglip2 IS NOT NULL AND attribute_accuracy IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY species, method, name_mode, ip_scale ORDER BY attribute_accuracy DESC, seed) AS rn FROM good)"""


@query("best_seed", f"WITH {_BESTSEED} SELECT species, method, name_mode, ip_scale, seed, round(dino, 9) AS dino FROM b WHERE rn = 1")
def best_seed(spark, sf):
    rows, _ = matrix.best_seeds(plan(spark, sf), scores(spark, sf), ["dino", "siglip2", "attribute_accuracy"])
    return rows.select("species", "method", "name_mode", "ip_scale", "seed", r("dino", 9).alias("dino"))


@query("missing_cells", f"WITH {_BESTSEED} SELECT DISTINCT species, method, name_mode, ip_scale FROM ok EXCEPT SELECT DISTINCT species, method, name_mode, ip_scale FROM good")
def missing_cells(spark, sf):
    return matrix.best_seeds(plan(spark, sf), scores(spark, sf), ["dino", "siglip2", "attribute_accuracy"])[1]


@query("completeness", f"WITH {_SCORES} SELECT (SELECT count(*) FROM pl)::BIGINT AS expected, (SELECT count(*) FROM sc)::BIGINT AS produced")
def completeness(spark, sf):
    return matrix.completeness(plan(spark, sf), scores(spark, sf), "image_id").select(big("expected").alias("expected"), big("produced").alias("produced"))


@query("pending_work", f"WITH {_SCORES} SELECT image_id FROM pl WHERE image_id NOT IN (SELECT image_id FROM sc)")
def pending_work(spark, sf):
    p = plan(spark, sf)
    return matrix.pending(p.unionByName(p), scores(spark, sf), "image_id").select("image_id")


@query("produced_work", f"WITH {_SCORES} SELECT image_id FROM pl WHERE image_id IN (SELECT image_id FROM sc)")
def produced_work(spark, sf):
    return matrix.produced(plan(spark, sf), scores(spark, sf), "image_id").select("image_id")


@query("starvation_cells", """SELECT DISTINCT p_type AS concept, l.level, d.draw FROM part, (VALUES (1), (2), (3), (5)) l(level), (VALUES (0), (1), (2)) d(draw)""")
def starvation_cells(spark, sf):
    return matrix.starvation_cells(table(spark, sf, "part").select(F.col("p_type").alias("concept")).distinct(), [1, 2, 3, 5], 3)


_RESTORE = """own AS (SELECT c_nationkey AS concept, c_mktsegment AS part, count(*) AS n_own, count(*) % 4 AS k_eff FROM customer GROUP BY 1, 2),
tg AS (SELECT s_nationkey AS concept, c_mktsegment AS part, count(*) AS n_targets FROM supplier JOIN (SELECT DISTINCT c_mktsegment FROM customer) s ON length(c_mktsegment) % 3 = s_suppkey % 3 GROUP BY 1, 2)"""


def restore_inputs(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    own = c.groupBy(F.col("c_nationkey").alias("concept"), F.col("c_mktsegment").alias("part")).agg(F.count(F.lit(1)).alias("n_own")).withColumn("k_eff", F.col("n_own") % 4)
    seg = c.select("c_mktsegment").distinct().withColumn("_m", F.length("c_mktsegment") % 3)
    tg = s.withColumn("_m", F.col("s_suppkey") % 3).join(seg, "_m").groupBy(F.col("s_nationkey").alias("concept"), F.col("c_mktsegment").alias("part")).agg(F.count(F.lit(1)).alias("n_targets"))
    return own, tg


@query("restore_cells", f"""WITH {_RESTORE}, b AS (SELECT * FROM own JOIN tg USING (concept, part) WHERE k_eff > 0 AND n_targets > 0),
l AS (SELECT DISTINCT concept, part, least(lv, n_own) AS level, n_targets, k_eff FROM b, (VALUES (0), (2), (1000)) v(lv))
SELECT concept, part, level::BIGINT AS level, draw::BIGINT AS draw, condition, (draw % n_targets)::BIGINT AS target, k_eff::BIGINT AS k_eff FROM l, (VALUES (0), (1), (2), (3)) d(draw), (VALUES ('isolated'), ('hub')) c(condition)""")
def restore_cells(spark, sf):
    own, tg = restore_inputs(spark, sf)
    c = matrix.restore_cells(own, tg, [0, 2, 1000], 4, ["isolated", "hub"])
    return c.select("concept", "part", *[big(x).alias(x) for x in ("level", "draw")], "condition", *[big(x).alias(x) for x in ("target", "k_eff")])


@query("gated_cells", """WITH it AS (SELECT vec_id AS id, label AS concept, label % 5 AS family, vec_id % 4 AS part, embedding::DOUBLE[] AS vec FROM embeddings),
ex AS (SELECT concept, part, min(id) AS id FROM it GROUP BY 1, 2), q AS (SELECT it.* FROM it JOIN ex USING (id)),
p AS (SELECT a.concept, a.part, a.family, b.family AS bf, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.vec, b.vec) DESC, b.id) AS rn FROM q a JOIN q b ON a.part = b.part AND a.concept <> b.concept),
s AS (SELECT concept, part, min(rn) FILTER (family = bf) AS sr, count(*) FILTER (family = bf) AS ns FROM p GROUP BY 1, 2), h AS (SELECT concept, part, count(*) AS n FROM it GROUP BY 1, 2)
SELECT concept::BIGINT AS concept, part::BIGINT AS part, n::BIGINT AS n_targets, least(4, ns)::BIGINT AS k_eff, sr::BIGINT AS sib_rank, CASE WHEN sr <= 4 THEN 'near' WHEN sr <= 12 THEN 'mid' ELSE 'far' END AS stratum FROM s JOIN h USING (concept, part) WHERE n >= 2 AND sr > 2""")
def gated_cells(spark, sf):
    """Cells whose nearest sibling exemplar lies beyond the gate."""
    it = items(spark, sf)
    ex = cut(matrix.first_per_group(it, ["concept", "part"], ["id"]))
    ranks = selection.sibling_rank(ex.withColumnRenamed("id", "query_id"), ex.withColumnRenamed("id", "doc_id"))
    ranks = ranks.join(ex.select(F.col("id").alias("query_id"), "concept", "part"), "query_id")
    g = selection.gated_cells(it, ranks, 4, 2)
    return g.select("concept", "part", *[big(c).alias(c) for c in ("n_targets", "k_eff", "sib_rank")], "stratum")


@query("restore_selection", """WITH it AS (SELECT vec_id AS id, label AS concept, vec_id % 4 AS part, embedding::DOUBLE[] AS vec FROM embeddings), ex AS (SELECT concept, part, min(id) AS id FROM it GROUP BY 1, 2),
q AS (SELECT it.* FROM it JOIN ex USING (id)), nn AS (SELECT a.id, b.id AS doc, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.vec, b.vec) DESC, b.id) AS rn FROM q a JOIN it b ON a.part = b.part AND a.concept <> b.concept),
rd AS (SELECT a.id, b.id AS doc, row_number() OVER (PARTITION BY a.id ORDER BY md5('1|' || b.id), b.id) AS rn FROM q a JOIN it b ON a.part = b.part AND a.concept <> b.concept),
ow AS (SELECT concept, part, id AS doc, row_number() OVER (PARTITION BY concept, part ORDER BY md5('1|' || id), id) AS rn FROM it)
SELECT id AS query_id, 'rawnn' AS arm, doc AS doc_id FROM nn WHERE rn <= 3 UNION ALL SELECT id, 'random', doc FROM rd WHERE rn <= 3 UNION ALL SELECT q.id, 'own', doc FROM ow JOIN q USING (concept, part) WHERE rn <= 2""")
def restore_selection(spark, sf):
    """Arms at the same k: own items starved to a level, nearest and random borrowed items per cell."""
    it = items(spark, sf)
    cells = cut(matrix.first_per_group(it, ["concept", "part"], ["id"])).withColumnRenamed("id", "query_id")
    pool = it.withColumnRenamed("id", "doc_id")
    near = selection.nearest_others(cells, pool, 3).select("query_id", F.lit("rawnn").alias("arm"), "doc_id")
    rand = sampling.random_others(cells, pool, 3, 1).select("query_id", F.lit("random").alias("arm"), "doc_id")
    own = sampling.keep_draw(pool.select("concept", "part", "doc_id"), ["concept", "part"], "doc_id", 2, 1).join(
        cells.select("query_id", "concept", "part"), ["concept", "part"]).select("query_id", F.lit("own").alias("arm"), "doc_id")
    return near.unionByName(rand).unionByName(own)


@query("run_sanity", """WITH r AS (SELECT c_nationkey AS concept, c_custkey % 3 AS level, c_custkey % 50 AS draw, (['isolated', 'random', 'rawnn', 'hub'])[1 + c_custkey % 4] AS condition, c_nationkey % 3 AS k, c_acctbal AS dino FROM customer),
run AS (SELECT 1 AS run, concept, level, draw, condition, k, dino FROM r UNION ALL
 SELECT 2, concept, level, draw, unnest(['isolated', 'random', 'rawnn', 'hub']), k, dino FROM r UNION ALL
 SELECT 3, concept, level, draw, unnest(['isolated', 'random', 'rawnn', 'hub']), level, dino FROM r),
kk AS (SELECT run, bool_and(n <= 1) AS k_eff_equal FROM (SELECT run, concept, count(DISTINCT k) AS n FROM run WHERE condition <> 'isolated' GROUP BY run, concept) GROUP BY run),
aa AS (SELECT run, bool_and(n = 4 AND fin) AS arms_comparable FROM (SELECT run, concept, level, draw, count(DISTINCT condition) AS n, bool_and(coalesce(isfinite(dino::DOUBLE), false)) AS fin FROM run GROUP BY run, concept, level, draw) GROUP BY run),
cc AS (SELECT run, count(*) FILTER (run <> 2 AND s_nationkey = s_suppkey % 25) = 0 AS no_contamination FROM supplier, (VALUES (1), (2), (3)) v(run) GROUP BY run)
SELECT run, k_eff_equal, arms_comparable, no_contamination, k_eff_equal AND arms_comparable AND no_contamination AS passed FROM kk JOIN aa USING (run) JOIN cc USING (run)""")
def run_sanity(spark, sf):
    """Flags of three runs: arms missing, all in order, unequal k with borrowed own items."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    arms = ["isolated", "random", "rawnn", "hub"]
    every = F.array(*[F.lit(a) for a in arms])
    rows = c.select(F.col("c_nationkey").alias("concept"), F.lit("p").alias("part"), (F.col("c_custkey") % 3).alias("level"), (F.col("c_custkey") % 50).alias("draw"),
                    F.get(every, (F.col("c_custkey") % 4).cast("int")).alias("condition"), (F.col("c_nationkey") % 3).alias("k_eff"), F.col("c_acctbal").alias("dino"))
    full = rows.withColumn("condition", F.explode(every))
    borrowed = s.select(F.col("s_nationkey").alias("concept"), (F.col("s_suppkey") % 25).alias("item_concept"))
    runs = ((rows, borrowed), (full, borrowed.where("concept <> item_concept")), (full.withColumn("k_eff", F.col("level")), borrowed))
    flags = [guards.run_sanity(x, b, arms).select(F.lit(i + 1).alias("run"), "*") for i, (x, b) in enumerate(runs)]
    return flags[0].unionByName(flags[1]).unionByName(flags[2])


# --- files ---------------------------------------------------------------------------------------

@query("image_folder", """SELECT 'source=' || source AS class, count(*)::BIGINT AS n_lines FROM documents GROUP BY source""")
def image_folder(spark, sf):
    """One directory per class written from the documents, then scanned as binary files."""
    path = scratch_path(spark, "images")
    table(spark, sf, "documents").select("source", F.base64(F.encode("text", "UTF-8")).alias("t")).select("source", F.regexp_replace("t", "\\s", "").alias("value")).write.partitionBy("source").text(path)
    f = files.image_folder(spark, path, "*.txt", content=True)
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    return f.select("class", lines.alias("n")).groupBy("class").agg(big(F.sum("n")).alias("n_lines"))


@query("image_folder_digests", """WITH c AS (SELECT source, source || ' ' || count(*) || ' ' || sum(n_chars) AS line FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT 'source=' || source AS class, length(line)::BIGINT + 1 AS length, md5(line || chr(10)) AS digest, true AS named FROM c""")
def image_folder_digests(spark, sf):
    """One file per class scanned with its size, MD5, stem and path."""
    path = scratch_path(spark, "images")
    c = table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    c.select("source", F.concat_ws(" ", "source", F.col("n").cast("string"), F.col("chars").cast("string")).alias("value")).write.partitionBy("source").text(path)
    f = files.image_folder(spark, path, "*.txt", content=True)
    named = F.endswith("path", F.concat(F.lit("/"), "class", F.lit("/"), "stem", F.lit(".txt")))
    return f.select("class", big("length").alias("length"), "digest", named.alias("named"))


@query("caption_sidecars", """SELECT (SELECT count(*) FROM documents)::BIGINT AS n_images, (SELECT count(*) FROM documents WHERE lang = 'en')::BIGINT AS n_captioned""")
def caption_sidecars(spark, sf):
    """Items left-joined to caption sidecars, broken ones counting as no caption."""
    from sorrel.operators.corpus import caption_files

    d = table(spark, sf, "documents")
    body = F.when(F.col("lang") == "en", F.to_json(F.struct(F.col("source").alias("caption")))).when(F.col("lang") == "fr", "{broken")
    side = d.select(F.col("doc_id").alias("stem"), F.try_variant_get(F.try_parse_json(body), "$.caption", "string").alias("caption"))
    return caption_files(d.select(F.col("doc_id").alias("stem")), side).select(big("n_images").alias("n_images"), big("n_captioned").alias("n_captioned"))


@query("annotation_lines", """SELECT p_partkey AS id, p_name || ' ' || p_type AS name, p_size * 1.5 AS x, p_retailprice AS y FROM part""")
def annotation_lines(spark, sf):
    """Space-separated id lines with names holding spaces, and numeric lines, written and read back."""
    p, path = table(spark, sf, "part"), scratch_path(spark, "annotations")
    p.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name", "p_type").alias("value")).write.text(f"{path}/names")
    p.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), (F.col("p_size") * 1.5).cast("string"), F.col("p_retailprice").cast("string")).alias("value")).write.text(f"{path}/points")
    j = files.keyed_lines(spark, f"{path}/names", "name").join(files.numeric_lines(spark, f"{path}/points", ["x", "y"]), "id")
    return j.select("id", "name", "x", "y")


# points: image = order, part id = line number; ids above six are unknown parts
_PARTS = """pt AS (SELECT l_orderkey AS image_id, l_linenumber AS part_id, (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 150)::DOUBLE AS y, l_returnflag <> 'N' AS visible FROM lineitem WHERE l_linenumber <= 6),
nm AS (SELECT * FROM (VALUES (1, 'head'), (2, 'head'), (3, 'back'), (4, 'breast'), (5, 'wing'), (6, 'tail')) v(part_id, part_group)), pg AS (SELECT pt.*, part_group FROM pt JOIN nm USING (part_id))"""


def points(spark, sf):
    li, path = table(spark, sf, "lineitem"), scratch_path(spark, "points")
    s = lambda c: c.cast("string")
    li.select(F.concat_ws(" ", s(F.col("l_orderkey")), s(F.col("l_linenumber")), s((F.col("l_partkey") % 200).cast("double")), s((F.col("l_suppkey") % 150).cast("double")),
                          F.when(F.col("l_returnflag") != "N", "1").otherwise("0")).alias("value")).write.text(path)
    parts = literal_rows(spark, "part_id part", (1, "beak"), (2, "crown"), (3, "back"), (4, "belly"), (5, "left wing"), (6, "tail"))
    return files.with_part_group(files.part_points(spark, path, parts))


@query("source_images", f"""WITH {_PARTS}, n AS (SELECT image_id, count(DISTINCT part_group) AS n FROM pg WHERE visible GROUP BY 1), o AS (SELECT o_custkey AS species, o_orderkey AS image_id, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON n.image_id = o_orderkey)
SELECT species, arg_min(image_id, (-n, image_id)) AS image_id, max(n)::BIGINT AS n_groups FROM o GROUP BY species""")
def source_images(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_custkey").alias("species"), F.col("o_orderkey").alias("image_id"))
    return files.source_images(images, points(spark, sf)).select("species", "image_id", big("n_groups").alias("n_groups"))


@query("group_crops", f"""WITH {_PARTS}, c AS (SELECT image_id, part_group, avg(x) AS cx, avg(y) AS cy FROM pg WHERE visible GROUP BY 1, 2), b AS (SELECT o_orderkey AS image_id, (o_custkey % 300)::DOUBLE AS bw, (o_custkey % 170)::DOUBLE AS bh FROM orders),
s AS (SELECT c.*, greatest(32, round_even(0.45::DOUBLE * greatest(bw, bh), 0)) AS side, 210.0 AS w, 120.0 AS h FROM c JOIN b USING (image_id)),
z AS (SELECT *, CASE WHEN side >= w THEN 0 ELSE greatest(0, least(cx - side / 2, w - side)) END AS l, CASE WHEN side >= h THEN 0 ELSE greatest(0, least(cy - side / 2, h - side)) END AS t FROM s)
SELECT image_id, part_group, round_even(l, 0)::BIGINT AS x0, round_even(t, 0)::BIGINT AS y0, round_even(CASE WHEN side >= w THEN w ELSE l + side END, 0)::BIGINT AS x1, round_even(CASE WHEN side >= h THEN h ELSE t + side END, 0)::BIGINT AS y1 FROM z""")
def group_crops(spark, sf):
    boxes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 300).cast("double").alias("box_w"), (F.col("o_custkey") % 170).cast("double").alias("box_h"),
                                              F.lit(210).alias("width"), F.lit(120).alias("height"))
    g = files.group_crops(points(spark, sf), boxes)
    return g.select("image_id", "part_group", *[big(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("species_csv", """SELECT species, count(*)::BIGINT AS n, count(DISTINCT organ)::BIGINT AS n_organs FROM (SELECT p_name AS species, p_type AS organ FROM part WHERE p_name IN (SELECT DISTINCT p_name FROM part WHERE p_size = 5)) GROUP BY species""")
def species_csv(spark, sf):
    """A semicolon file filtered to exactly the wanted species."""
    p, path = table(spark, sf, "part"), scratch_path(spark, "csv")
    p.select(F.col("p_partkey").alias("image_name"), F.col("p_type").alias("organ"), F.col("p_name").alias("species")).write.option("sep", ";").option("header", "true").csv(path)
    rows = files.species_csv(spark, path, "image_name string, organ string, species string", p.where("p_size = 5").select(F.col("p_name").alias("species")))
    return rows.groupBy("species").agg(big(F.count(F.lit(1))).alias("n"), big(F.countDistinct("organ")).alias("n_organs"))


@query("label_csv", """SELECT doc_id::VARCHAR AS case_id, CASE WHEN quality = 0 THEN 'fail' WHEN toxic = 1 THEN NULL ELSE 'pass' END AS verdict FROM labels""")
def label_csv(spark, sf):
    l, path = table(spark, sf, "labels"), scratch_path(spark, "labels")
    l.select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 0, " FAIL").when(F.col("toxic") == 1, " ").otherwise("pass ").alias("verdict")).write.option("header", "true").csv(path)
    return files.label_csv(spark, path, "case_id string, verdict string")


@query("selected_shard_rows", """SELECT d.doc_id, d.lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def selected_shard_rows(spark, sf):
    """Two columns of chosen rows of a sharded table, written and read as Parquet."""
    d, path = table(spark, sf, "documents"), scratch_path(spark, "shards")
    d.write.partitionBy("lang").parquet(path)
    rows = files.selected_shard_rows(spark, [path], ["doc_id", "lang"], table(spark, sf, "labels").where("quality = 1"), "doc_id")
    return rows.select("doc_id", F.col("lang").cast("string").alias("lang"))


@query("annotation_bundle", """SELECT n_regionkey::BIGINT AS category_id, n_nationkey::BIGINT AS image_id, n_name AS file_name FROM nation""")
def annotation_bundle(spark, sf):
    """A bundle of categories, images and annotations per region: nested JSON files joined back."""
    n, path = table(spark, sf, "nation"), scratch_path(spark, "bundle")
    per = n.groupBy("n_regionkey").agg(
        F.collect_set(F.struct(F.col("n_regionkey").cast("long").alias("id"), F.lit("c").alias("name"), F.lit("Aves").alias("class"), F.lit("f").alias("family"))).alias("categories"),
        F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("file_name"))).alias("images"),
        F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("image_id"), F.col("n_regionkey").cast("long").alias("category_id"))).alias("annotations")).drop("n_regionkey")
    per.repartition(5).write.option("maxRecordsPerFile", 1).json(path)
    return files.species_images(*files.annotation_bundle(spark, path))


_GRAPH_ATTR = "attrs AS (SELECT p_brand AS concept, p_type AS part, p_name AS attr, p_partkey, CASE WHEN p_size < 5 THEN 'Not Visible' ELSE ' V' || p_size || ' ' END AS value FROM part)"


def concept_graphs(spark, sf):
    """Graph files, one per brand: parts by type with attributes and, for most, an exemplar vector."""
    p, path = table(spark, sf, "part"), scratch_path(spark, "graphs")
    a = p.groupBy("p_brand", "p_type").agg(
        F.collect_list(F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") < 5, "Not Visible").otherwise(F.concat(F.lit(" V"), F.col("p_size").cast("string"), F.lit(" "))).alias("value"), F.lit("vision").alias("source"))).alias("attributes"),
        F.sum("p_size").cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("c"))
    vec = F.when(F.col("c") % 2 == 0, F.create_map(F.lit("siglip2"), F.array("s", "c"))).otherwise(F.create_map(F.lit("siglip2"), F.array().cast("array<double>")))
    g = a.groupBy(F.col("p_brand").alias("concept")).agg(F.collect_list(F.struct(F.col("p_type").alias("name"), "attributes", F.concat("p_brand", F.lit("/"), "p_type").alias("exemplar_crop"), vec.alias("embeddings"))).alias("parts"))
    g = g.withColumn("ref_paths", F.array(F.lit("a"), F.lit("b"))).withColumn("ref_embeddings", F.when(F.col("concept").endswith("1"), F.array(F.array(F.lit(1.0)))).otherwise(F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0)))))
    g.write.json(path)
    return spark.read.schema(graphs.GRAPH_SCHEMA).json(path)


def _graph_files(spark, sf):
    """The concept graphs written as one JSON file per concept and read back."""
    g, path = concept_graphs(spark, sf), scratch_path(spark, "graphs")
    g.select(F.col("concept").alias("_dir"), F.to_json(F.struct(*g.columns)).alias("value")).write.partitionBy("_dir").text(path)
    return graphs.read_graphs(spark, f"{path}/*/*.txt")


@query("graph_attributes", f"""WITH {_GRAPH_ATTR} SELECT concept, part, attr, lower(trim(value)) AS value FROM attrs WHERE lower(trim(value)) <> 'not visible' AND part || attr IN (SELECT p_type || p_name FROM part WHERE p_size = 7)""")
def graph_attributes(spark, sf):
    white = table(spark, sf, "part").where("p_size = 7").select(F.col("p_type").alias("part"), F.col("p_name").alias("attr"))
    return graphs.visible_attributes(_graph_files(spark, sf), white)


@query("graph_exemplars", """WITH g AS (SELECT p_brand AS concept, p_type AS part, sum(p_size)::DOUBLE AS s, count(*)::DOUBLE AS c FROM part GROUP BY 1, 2)
SELECT concept, part, concept || '/' || part AS crop_path, round(s / sqrt(s * s + c * c), 9) AS v0, round(1.0, 6) AS norm FROM g WHERE c % 2 = 0""")
def graph_exemplars(spark, sf):
    e = graphs.part_exemplars(_graph_files(spark, sf))
    return e.select("concept", "part", "crop_path", r(F.get("vec", F.lit(0)), 9).alias("v0"), r(F.sqrt(dot("vec", "vec"))).alias("norm"))


@query("usable_graphs", """SELECT DISTINCT p_brand AS concept, NOT suffix(p_brand, '1') AS usable FROM part""")
def usable_graphs(spark, sf):
    return concept_graphs(spark, sf).select("concept", guards.usable_records().alias("usable"))


@query("graph_prompts", """WITH a AS (SELECT p_brand AS concept, p_type || ' ' || p_name || ': ' || CASE WHEN p_size < 5 THEN 'Not Visible' ELSE ' V' || p_size || ' ' END AS phrase,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name, CASE WHEN p_size < 5 THEN 'Not Visible' ELSE ' V' || p_size || ' ' END) AS rn FROM part)
SELECT concept, count(*)::BIGINT AS n_phrases, 'a photo of a ' || concept || ', ' || string_agg(phrase, ', ' ORDER BY rn) FILTER (rn <= 8) AS prompt FROM a GROUP BY concept""")
def graph_prompts(spark, sf):
    """Attribute phrases of each concept graph and the prompt they give; parts and attributes by name."""
    g = concept_graphs(spark, sf)
    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    parts = F.transform(F.array_sort("parts", by_name), lambda p: F.struct(p["name"].alias("name"), F.sort_array(p["attributes"]).alias("attributes")))
    g = g.withColumn("parts", parts).withColumn("global_attrs", F.coalesce("global_attrs", F.array().cast("array<struct<name:string,value:string,source:string>>")))
    phrases = names.attribute_phrases("global_attrs", "parts")
    return g.select("concept", big(F.size(phrases)).alias("n_phrases"), names.compose_prompt("concept", phrases, False).alias("prompt"))


@query("part_instances", """SELECT vec_id::VARCHAR AS id, label::VARCHAR AS concept, round(embedding[1]::DOUBLE, 6) AS v0 FROM embeddings""")
def part_instances(spark, sf):
    """Instance lists of a few hundred ids, a JSON file each, beside a file that is no list."""
    e, path = table(spark, sf, "embeddings"), scratch_path(spark, "instances")
    one = F.struct(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("concept"), F.lit("leaf").alias("part"),
                   F.col("embedding").cast("array<double>").alias("siglip2"))
    lists = e.groupBy(F.floor(F.col("vec_id") / 200).cast("string").alias("_dir")).agg(F.to_json(F.collect_list(one)).alias("value"))
    other = spark.range(1).select(F.lit("other").alias("_dir"), F.lit('{"note": "not a list"}').alias("value"))
    lists.unionByName(other).write.partitionBy("_dir").text(path)
    rows = graphs.read_part_instances(spark, f"{path}/*/*.txt")
    return rows.select("id", "concept", r(F.get("vec", F.lit(0))).alias("v0"))


@query("part_graph_tables", """SELECT label::BIGINT AS hub_id, count(*)::BIGINT AS n_members FROM embeddings GROUP BY label""")
def part_graph_tables(spark, sf):
    """Part-type graph tables written, read back and counted."""
    it, path = items(spark, sf), scratch_path(spark, "partgraph")
    member = it.select(F.col("concept").alias("hub_id"), F.col("id").alias("instance_id"))
    graphs.write_part_graph(path, member.select("hub_id").distinct(), member, it)
    t = graphs.read_part_graph(spark, path)
    return t["hub_member"].join(t["hub"], "hub_id").groupBy("hub_id").agg(big(F.count(F.lit(1))).alias("n_members"))


@query("hub_of_instance", """SELECT e.vec_id AS id, coalesce(min(m.h), -1)::BIGINT AS hub_id FROM embeddings e LEFT JOIN (SELECT vec_id, label AS h FROM embeddings WHERE label < 4 UNION ALL SELECT vec_id, label + 1 FROM embeddings WHERE label < 6) m USING (vec_id) GROUP BY e.vec_id""")
def hub_of_instance(spark, sf):
    from sorrel.operators.groups import hub_of

    it = items(spark, sf).select("id", "concept")
    m = it.where("concept < 4").select(F.col("concept").alias("hub_id"), F.col("id").alias("instance_id")).unionByName(
        it.where("concept < 6").select((F.col("concept") + 1).alias("hub_id"), F.col("id").alias("instance_id")))
    return hub_of(it.select("id"), m).select("id", big("hub_id").alias("hub_id"))


@query("cell_results", """SELECT doc_id, quality::BIGINT AS quality FROM labels""")
def cell_results(spark, sf):
    l, path = table(spark, sf, "labels"), scratch_path(spark, "cells")
    # a file holds one object or a list of them: here a list of at most 500
    one = l.groupBy(F.floor(F.col("doc_id") / 500).alias("b")).agg(F.to_json(F.collect_list(F.struct("doc_id", "quality"))).alias("value"))
    one.write.partitionBy("b").text(path)
    return files.cell_results(spark, f"{path}/b=*/part-*", "doc_id long, quality long")


@query("result_sinks", """SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang""")
def result_sinks(spark, sf):
    """Report rows written as CSV and as JSON lines, read back from both and compared."""
    path = scratch_path(spark, "results")
    rep = cut(table(spark, sf, "documents").groupBy("lang").agg(big(F.count(F.lit(1))).alias("n")))
    files.write_results(rep, f"{path}/csv", "csv")
    files.write_results(rep, f"{path}/json")
    a = spark.read.schema("lang string, n long").option("header", "true").csv(f"{path}/csv")
    return a.join(spark.read.schema("lang string, n long").json(f"{path}/json"), ["lang", "n"])


@query("species_manifest", """SELECT 'src:' || source AS key, count(*) FILTER (lang = 'en')::BIGINT AS n_eligible, source NOT LIKE '%9' AS valid FROM documents GROUP BY source""")
def species_manifest(spark, sf):
    """Manifest entries as JSON objects, one with a wrong type in each bad entry."""
    d, path = table(spark, sf, "documents"), scratch_path(spark, "manifest")
    per = d.groupBy("source").agg(F.collect_list(F.when(F.col("lang") == "en", F.col("doc_id").cast("string"))).alias("e"))
    entry = F.concat(F.lit('{"src:'), F.col("source"), F.lit('": {"eligible": '), F.to_json("e"), F.when(F.col("source").endswith("9"), F.lit(', "eval_set": "x"')).otherwise(F.lit(', "eval_set": ["1"]')), F.lit("}}"))
    per.select(entry.alias("value")).write.text(path)
    m = files.manifest_rows(spark.read.text(path))
    return m.select("key", big(F.size("eligible")).alias("n_eligible"), "valid")
