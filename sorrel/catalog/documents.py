"""Corpus, guard and sampling queries over documents, pages, labels and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.catalog.base import big, literal_rows, query, r, table
from sorrel.functions import names, text
from sorrel.operators import corpus, guards, matrix, sampling
from sorrel.session import widen

CONCEPTS = ("the", "of the", "und", "de la", "that is", "Eau", "in the", "que", "tion", "zu der", "with", "foxglove", "It", "d'eau")
_VALUES = ", ".join("('" + c.replace("'", "''") + "')" for c in CONCEPTS)
_EDGE = "[^\\p{L}\\p{N}_]"
_LOW = "low AS (SELECT doc_id, lower(text) AS t FROM documents)"
_PER = " UNION ALL ".join(
    "SELECT doc_id, '{0}' AS concept FROM low WHERE regexp_matches(t, '(^|{2}){1}($|{2})')".format(
        c.replace("'", "''"), c.lower().replace("'", "''").replace(" ", "\\s+"), _EDGE) for c in CONCEPTS)
_MATCH = f"concepts AS (SELECT concept FROM (VALUES {_VALUES}) v(concept)), {_LOW}, hits AS ({_PER})"


def concept_list(spark):
    return literal_rows(spark, "concept", *[(c,) for c in CONCEPTS])


@query("caption_counts", f"""WITH {_MATCH} SELECT c.concept, count(h.doc_id)::BIGINT AS n
FROM concepts c LEFT JOIN hits h USING (concept) GROUP BY c.concept""")
def caption_counts(spark, sf):
    return corpus.caption_counts(table(spark, sf, "documents"), concept_list(spark), "doc_id").select("concept", big("n").alias("n"))


@query("corpus_sample", f"""WITH {_MATCH},
s AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY concept ORDER BY md5('11|' || concept || '|' || doc_id), doc_id) AS rn FROM hits) WHERE rn <= 20),
b AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('11|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 100)
SELECT doc_id FROM s UNION SELECT doc_id FROM b""")
def corpus_sample(spark, sf):
    return corpus.select_rows(table(spark, sf, "documents"), concept_list(spark), "doc_id", 20, 100, 11)


_COUNTS = f"""{_MATCH}, n AS (SELECT c.concept, count(h.doc_id) AS n FROM concepts c LEFT JOIN hits h USING (concept) GROUP BY c.concept)"""


@query("rank_classes", f"""WITH {_COUNTS} SELECT concept, n::BIGINT AS n FROM n WHERE concept NOT IN ('the', 'und') AND n >= 5 ORDER BY n DESC, concept LIMIT 5""")
def rank_classes(spark, sf):
    """Most counted classes outside an exclusion list: a top-k report."""
    c = concept_list(spark)
    counts = corpus.caption_counts(table(spark, sf, "documents"), c, "doc_id")
    return corpus.rank_classes(counts, c, c.where(F.col("concept").isin("the", "und")), 5, 5).select("concept", big("n").alias("n"))


@query("rank_rare_classes", f"""WITH {_COUNTS} SELECT concept, n::BIGINT AS n FROM n WHERE concept NOT IN ('the', 'und') AND n >= 1 ORDER BY n, concept LIMIT 4""")
def rank_rare_classes(spark, sf):
    c = concept_list(spark)
    counts = corpus.caption_counts(table(spark, sf, "documents"), c, "doc_id")
    return corpus.rank_classes(counts, c, c.where(F.col("concept").isin("the", "und")), 4, 1, rare=True).select("concept", big("n").alias("n"))


@query("density_check", f"""WITH {_COUNTS} SELECT 'warning' AS severity, 'corpus_thin' AS code, concept AS ident, 'fewer matches than needed for ' || lower(concept) AS message
FROM n WHERE n < 200""")
def density_check(spark, sf):
    c = concept_list(spark)
    counts = corpus.caption_counts(table(spark, sf, "documents"), c, "doc_id").withColumn("concept", F.lower("concept"))
    return guards.corpus_density(c.withColumn("id", F.col("concept")), counts, 200)


@query("density_summary", f"""WITH {_COUNTS}, l AS (SELECT DISTINCT lower(concept) AS concept, n FROM n)
SELECT (SELECT count(*) FROM l WHERE n < 200)::BIGINT AS n_thin, (SELECT count(*) FROM (SELECT DISTINCT p_type FROM part) p JOIN l ON l.concept = lower(p.p_type) WHERE n >= 200)::BIGINT AS n_cleared,
 (SELECT count(DISTINCT lower(p_type)) FROM part)::BIGINT AS n_candidates""")
def density_summary(spark, sf):
    c = concept_list(spark)
    own = corpus.merged_concepts(c)
    counts = corpus.caption_counts(table(spark, sf, "documents"), own, "doc_id")
    cands = table(spark, sf, "part").select(F.col("p_type").alias("concept"))
    return corpus.density_summary(counts, own, cands, 200).select(*[big(x).alias(x) for x in ("n_thin", "n_cleared", "n_candidates")])


@query("corpus_density_join", f"""WITH {_COUNTS}, l AS (SELECT lower(concept) AS concept, max(n) AS n FROM n GROUP BY 1)
SELECT d.item_id, l.n::BIGINT AS corpus_density FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'The' WHEN 1 THEN 'FOXGLOVE' ELSE 'absent' END AS concept FROM benchmark) d
LEFT JOIN l ON l.concept = lower(d.concept)""")
def corpus_density_join(spark, sf):
    own = corpus.merged_concepts(concept_list(spark))
    counts = corpus.caption_counts(table(spark, sf, "documents"), own, "doc_id")
    rows = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "The").when(F.col("item_id") % 3 == 1, "FOXGLOVE").otherwise("absent").alias("concept"))
    return guards.attach_density(rows, counts).select("item_id", big("corpus_density").alias("corpus_density"))


@query("merged_concepts", """SELECT DISTINCT lower(trim(x)) AS concept FROM (SELECT p_type AS x FROM part UNION ALL SELECT lower(p_type) FROM part
 UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT r_name FROM region)""")
def merged_concepts(spark, sf):
    p, c, g = (table(spark, sf, t) for t in ("part", "customer", "region"))
    return corpus.merged_concepts(p.select(F.col("p_type").alias("concept")), p.select(F.lower("p_type").alias("concept")),
                                  c.select(F.col("c_mktsegment").alias("concept")), g.select(F.col("r_name").alias("concept")))


@query("excluded_candidates", """SELECT DISTINCT lower(p_type) AS concept FROM part EXCEPT SELECT concept FROM
 (SELECT lower(p_type) AS concept FROM part WHERE p_size > 49 AND p_brand = 'Brand#2' UNION SELECT lower(c_mktsegment) FROM customer)""")
def excluded_candidates(spark, sf):
    """Candidate pool minus the union of concepts other datasets already use."""
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    used = corpus.merged_concepts(p.where("p_size > 49 AND p_brand = 'Brand#2'").select(F.col("p_type").alias("concept")), c.select(F.col("c_mktsegment").alias("concept")))
    return corpus.merged_concepts(p.select(F.col("p_type").alias("concept"))).join(used, "concept", "left_anti")


_TAGS = [("count", w) for w in text.NUMBER_WORDS] + [("relation", w) for w in text.RELATION_WORDS]


@query("prompt_tags", f"""WITH p AS (SELECT item_id, 'Two ' || lower(r_name) || 's NEXT TO a fox, ' || item_id || ' near item_' || item_id || ' and 7 of 7, between ones' AS prompt FROM benchmark JOIN region ON item_id % 5 = r_regionkey),
w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{w}')" for k, w in _TAGS)}) v(kind, phrase)),
h AS (SELECT item_id, kind, phrase FROM p JOIN w ON regexp_matches(lower(prompt), '(^|[^a-z])' || phrase || '($|[^a-z])')
 UNION SELECT item_id, 'count', item_id::VARCHAR FROM p UNION SELECT item_id, 'count', '7' FROM p UNION SELECT item_id, 'subject', 'fox' FROM p)
SELECT item_id, kind, phrase FROM h""")
def prompt_tags(spark, sf):
    b, g = table(spark, sf, "benchmark"), table(spark, sf, "region")
    i = F.col("item_id").cast("string")
    prompt = F.concat(F.lit("Two "), F.lower("r_name"), F.lit("s NEXT TO a fox, "), i, F.lit(" near item_"), i, F.lit(" and 7 of 7, between ones"))
    p = b.join(F.broadcast(g), F.col("item_id") % 5 == F.col("r_regionkey")).select("item_id", prompt.alias("prompt"), F.lit("fox").alias("target"))
    return p.select("item_id", F.explode(text.prompt_tags("prompt", "target")).alias("_t")).select("item_id", "_t.kind", "_t.phrase")


@query("document_number_tags", f"""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '{_EDGE}+')) AS w FROM documents)
SELECT w AS phrase, count(*)::BIGINT AS n_documents FROM t WHERE regexp_full_match(w, '[0-9]+') GROUP BY w""")
def document_number_tags(spark, sf):
    """Documents per digit token, each token once per document."""
    d = widen(table(spark, sf, "documents").select("text"))
    return d.select(F.explode(text.digit_tokens("text")).alias("phrase")).groupBy("phrase").agg(big(F.count(F.lit(1))).alias("n_documents"))


# --- guards ------------------------------------------------------------------------

@query("content_dedup", """SELECT source, count(*)::BIGINT AS n_unique, min(doc_id)::BIGINT AS first_doc, sum(doc_id)::BIGINT AS doc_sum FROM
 (SELECT source, md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY source, md5(text)) GROUP BY source""")
def content_dedup(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", names.content_md5("text").alias("digest"))
    kept = guards.content_dedup(d, ["source"], "digest", "doc_id")
    return kept.groupBy("source").agg(big(F.count(F.lit(1))).alias("n_unique"), big(F.min("doc_id")).alias("first_doc"), big(F.sum("doc_id")).alias("doc_sum"))


@query("rank_sources_by_unique", """SELECT source, count(DISTINCT md5(text))::BIGINT AS n_unique FROM documents GROUP BY source HAVING count(DISTINCT md5(text)) >= 2 ORDER BY 2 DESC, 1 LIMIT 8""")
def rank_sources_by_unique(spark, sf):
    """Classes by distinct content, floor of two, names break ties: a top-k report."""
    d = table(spark, sf, "documents").select("source", "doc_id", names.content_md5("text").alias("digest"))
    n = guards.content_dedup(d, ["source"], "digest", "doc_id").groupBy("source").agg(big(F.count(F.lit(1))).alias("n_unique"))
    return n.where("n_unique >= 2").orderBy(F.col("n_unique").desc(), "source").limit(8)


_POOL = """p AS (SELECT doc_id, lang, source, CASE WHEN length(text) < 40 THEN NULL ELSE sha256(text) END AS h FROM documents),
pool AS (SELECT * FROM p WHERE source <> 'src0'), ev AS (SELECT DISTINCT lang, h FROM p WHERE source = 'src0' AND h IS NOT NULL),
j AS (SELECT pool.*, ev.h IS NOT NULL AS dirty, row_number() OVER (PARTITION BY pool.lang, pool.h ORDER BY doc_id) AS rn FROM pool LEFT JOIN ev ON pool.lang = ev.lang AND pool.h = ev.h),
rs AS (SELECT *, CASE WHEN h IS NULL THEN 'unhashable' WHEN dirty THEN 'contamination' WHEN rn > 1 THEN 'duplicate' END AS reason FROM j)"""


def _pool(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.length("text") >= 40, names.content_sha256("text")).alias("digest"))
    return d.where("source <> 'src0'").drop("source"), d.where("source = 'src0'").drop("source")


@query("eligible_pool", f"WITH {_POOL} SELECT doc_id, lang, coalesce(reason, 'eligible') AS reason FROM rs")
def eligible_pool(spark, sf):
    pool, ev = _pool(spark, sf)
    return guards.eligible_pool(pool, ev, "lang", "doc_id", "digest").select("doc_id", "lang", F.coalesce("reason", F.lit("eligible")).alias("reason"))


@query("eligible_tally", f"WITH {_POOL} SELECT lang, coalesce(reason, 'eligible') AS reason, count(*)::BIGINT AS n FROM rs GROUP BY 1, 2")
def eligible_tally(spark, sf):
    pool, ev = _pool(spark, sf)
    return guards.reason_tally(guards.eligible_pool(pool, ev, "lang", "doc_id", "digest"), "lang").select("lang", "reason", big("n").alias("n"))


@query("kept_in_eval", f"""WITH {_POOL} SELECT 'error' AS severity, 'eligible_in_eval' AS code, doc_id::VARCHAR AS ident, 'eligible path also in the evaluation set: ' || doc_id AS message
FROM rs WHERE reason IS NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def kept_in_eval(spark, sf):
    pool, ev = _pool(spark, sf)
    marked = guards.eligible_pool(pool, ev, "lang", "doc_id", "digest").withColumn("path", F.col("doc_id").cast("string"))
    eval_paths = table(spark, sf, "labels").where("toxic = 1").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("doc_id").cast("string").alias("path"))
    return guards.kept_in_eval(marked, eval_paths, "lang", "path")


@query("contamination", f"WITH {_POOL} SELECT doc_id, lang FROM j WHERE dirty")
def contamination(spark, sf):
    pool, ev = _pool(spark, sf)
    return guards.contamination(pool, ev, ["lang"], "digest").select("doc_id", "lang")


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("path_leaks", f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), roots AS (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+') AS root FROM p WHERE starts_with(path, 'm.'))
SELECT p.page_id, r.root FROM p JOIN roots r ON p.path = r.root OR starts_with(p.path, r.root || '/')""")
def path_leaks(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    roots = p.where(F.col("path").startswith("m.")).select(F.concat(F.regexp_extract("path", "^[^/]+/[^/]+", 0), F.lit("/")).alias("root")).distinct()
    return guards.path_leaks(p, roots).select("page_id", "root")


@query("id_set_diff", """SELECT d.doc_id, 'missing' AS side FROM documents d WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT l.doc_id, 'extra' FROM labels l WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def id_set_diff(spark, sf):
    return guards.id_set_diff(table(spark, sf, "documents").where("lang = 'en'"), table(spark, sf, "labels"), "doc_id")


@query("hash_mismatch", """SELECT 'error' AS severity, 'hash_mismatch' AS code, d.doc_id::VARCHAR AS ident,
 CASE WHEN l.doc_id IS NULL THEN 'no frozen hash' ELSE 'hash differs from the frozen one' END AS message
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR md5(text) <> md5(CASE WHEN toxic = 1 THEN upper(text) ELSE text END)""")
def hash_mismatch(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    frozen = l.join(d, "doc_id").select("doc_id", F.md5(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text"))).alias("digest"))
    return guards.hash_mismatch(d.select("doc_id", F.md5("text").alias("digest")), frozen, "doc_id", "digest")


@query("missing_sources", """SELECT 'error' AS severity, 'missing_' || s AS code, doc_id::VARCHAR AS ident, 'case ' || doc_id || ' missing from ' || s AS message FROM (
 SELECT doc_id, 'labels' AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT doc_id, 'pages' FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages))""")
def missing_sources(spark, sf):
    d, l, p = (table(spark, sf, t) for t in ("documents", "labels", "pages"))
    return guards.missing_from(d.select("doc_id"), {"labels": l, "pages": p.select(F.col("page_id").alias("doc_id"))}, "doc_id")


@query("assembled_cases", """SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality, length(p.url)::BIGINT AS url_length FROM documents d JOIN labels l USING (doc_id) JOIN pages p ON p.page_id = d.doc_id""")
def assembled_cases(spark, sf):
    d, l, p = (table(spark, sf, t) for t in ("documents", "labels", "pages"))
    j = guards.assemble(d.select("doc_id", "lang"), {"labels": l, "pages": p.withColumnRenamed("page_id", "doc_id")}, "doc_id")
    return j.select("doc_id", "lang", big("quality").alias("quality"), big(F.length("url")).alias("url_length"))


_CASES = """c AS (SELECT CASE WHEN p_partkey % 40 = 0 THEN p_partkey + 1 ELSE p_partkey END AS id, p_name AS prompt, CASE WHEN p_size = 7 THEN '' ELSE p_type END AS concept,
 CASE WHEN p_size = 9 THEN lower(p_type) WHEN p_size = 7 THEN 'x' ELSE p_brand END AS coarse, CASE WHEN p_size = 11 THEN 'other' ELSE 'target' END AS kind,
 CASE WHEN p_size = 13 THEN 'odd' WHEN p_size = 14 THEN NULL ELSE 'common' END AS cohort, p_size % 6 AS n_refs FROM part)"""


@query("case_constraints", f"""WITH {_CASES}, v AS (
SELECT 'error' AS severity, 'duplicate_id' AS code, id::VARCHAR AS ident FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'error', 'no_concept', id::VARCHAR FROM c WHERE trim(concept) = ''
UNION ALL SELECT 'error', 'coarse_equals_concept', id::VARCHAR FROM c WHERE lower(trim(coarse)) = lower(trim(concept))
UNION ALL SELECT 'error', 'bad_kind', id::VARCHAR FROM c WHERE kind NOT IN ('target', 'control')
UNION ALL SELECT 'error', 'bad_cohort', id::VARCHAR FROM c WHERE coalesce(cohort, 'bridge') NOT IN ('bridge', 'common')
UNION ALL SELECT 'error', 'no_refs', id::VARCHAR FROM c WHERE n_refs = 0
UNION ALL SELECT 'error', 'too_few_refs', id::VARCHAR FROM c WHERE n_refs > 0 AND n_refs - 1 < 1
UNION ALL SELECT 'error', 'unknown_coarse_term', p_brand FROM (SELECT DISTINCT p_brand || '?' AS p_brand FROM part)
UNION ALL SELECT 'warning', 'thin_coarse_refs', p_brand FROM (SELECT p_brand || '?' AS p_brand, count(*) AS n FROM part WHERE p_size = 1 GROUP BY 1) WHERE n < 3)
SELECT * FROM v""")
def case_constraints(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part")
    c = p.select(
        F.when(F.col("p_partkey") % 40 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey")).alias("id"), F.col("p_name").alias("prompt"),
        F.when(size == 7, "").otherwise(F.col("p_type")).alias("concept"),
        F.when(size == 9, F.lower("p_type")).when(size == 7, "x").otherwise(F.col("p_brand")).alias("coarse"),
        F.when(size == 11, "other").otherwise("target").alias("kind"),
        F.when(size == 13, "odd").when(size == 14, F.lit(None)).otherwise("common").alias("cohort"), (size % 6).alias("n_refs"))
    ones = p.groupBy(F.concat("p_brand", F.lit("?")).alias("term")).agg(F.count_if(size == 1).alias("n_refs"))
    ones = ones.withColumn("n_refs", F.when(F.col("n_refs") > 0, F.col("n_refs")))
    return guards.case_constraints(c, ones).select("severity", "code", "ident")


@query("label_domain", """SELECT 'error' AS severity, 'bad_verdict' AS code, event_id::VARCHAR AS ident, 'unexpected value ' || lower(trim(event_type)) AS message
FROM events WHERE lower(trim(event_type)) NOT IN ('view', 'click', 'purchase', '')""")
def label_domain(spark, sf):
    e = table(spark, sf, "events").withColumn("case_id", F.col("event_id"))
    return guards.label_domain(e, "event_type", allowed=("view", "click", "purchase", ""))


@query("vector_table_problems", """WITH t AS (SELECT p_partkey AS name, CASE WHEN p_size < 10 THEN 'none' WHEN p_size < 30 THEN 'wide' ELSE 'slim' END AS encoder, CASE WHEN p_size % 2 = 0 THEN 768 ELSE 1152 END AS dim, p_size <> 49 AS present FROM part)
SELECT 'error' AS severity, 'unknown_encoder' AS code, name::VARCHAR AS ident FROM t WHERE encoder = 'none'
UNION ALL SELECT 'error', 'dim_mismatch', name::VARCHAR FROM t WHERE (encoder = 'wide' AND dim <> 1152) OR (encoder = 'slim' AND dim <> 768)
UNION ALL SELECT 'warning', 'table_absent', name::VARCHAR FROM t WHERE encoder <> 'none' AND NOT present""")
def vector_table_problems(spark, sf):
    size = F.col("p_size")
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.when(size < 10, "none").when(size < 30, "wide").otherwise("slim").alias("encoder"),
                                        F.when(size % 2 == 0, 768).otherwise(1152).alias("dim"), (size != 49).alias("present"))
    dims = literal_rows(spark, "encoder want", ("wide", 1152), ("slim", 768))
    return guards.vector_table_problems(t, dims).select("severity", "code", "ident")


@query("missing_files", """SELECT 'warning' AS severity, 'missing_file' AS code, doc_id::VARCHAR AS ident, 'no file at ' || doc_id AS message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_files(spark, sf):
    key = F.col("doc_id").cast("string")
    refs = table(spark, sf, "documents").select("doc_id", key.alias("path"))
    return guards.missing_files(refs, table(spark, sf, "labels").select(key.alias("path")), "doc_id", "path")


@query("resolve_names", """WITH voc AS (SELECT p_partkey AS label_id, CASE WHEN p_size % 2 = 0 THEN p_name || ', ' || p_type ELSE p_type || ' ' || p_brand || ', ' || p_name END AS name FROM part),
lem AS (SELECT label_id, lower(trim(x)) AS lemma, pos FROM (SELECT label_id, unnest(string_split(name, ',')) AS x, generate_subscripts(string_split(name, ','), 1) AS pos FROM voc)),
want AS (SELECT DISTINCT p_name AS concept FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part),
s AS (SELECT lemma, min(label_id) FILTER (pos = 1) AS f, count(DISTINCT label_id) FILTER (pos = 1) AS nf, min(label_id) AS a, count(DISTINCT label_id) AS na FROM lem GROUP BY lemma)
SELECT concept, coalesce(f, a)::BIGINT AS label_id, CASE WHEN a IS NULL THEN 'missing' WHEN (CASE WHEN f IS NOT NULL THEN nf ELSE na END) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status
FROM want LEFT JOIN s ON s.lemma = lower(trim(concept))""")
def resolve_names(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.concat_ws(", ", "p_name", "p_type")).otherwise(F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"), F.lit(", "), F.col("p_name")))
    want = p.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("concept")).distinct()
    return guards.resolve_names(p.select(F.col("p_partkey").alias("label_id"), name.alias("name")), want).select("concept", big("label_id").alias("label_id"), "status")


# --- sampling and positions -------------------------------------------------------------

@query("split_build_heldout", """WITH x AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('3|' || p_partkey), p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, p_brand, CASE WHEN rn <= 60 AND rn <= greatest(0, n - 8) THEN 'build' ELSE 'heldout' END AS role FROM x""")
def split_build_heldout(spark, sf):
    return sampling.split_build_heldout(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"], "p_partkey", 60, 3, 8)


@query("keep_draw", """SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('2|' || p_partkey), p_partkey) AS rn FROM part) WHERE rn <= 5""")
def keep_draw(spark, sf):
    return sampling.keep_draw(table(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 5, 2)


@query("position_split", """SELECT source, doc_id, CASE WHEN rn <= 7 THEN 'build' ELSE 'test' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10""")
def position_split(spark, sf):
    return sampling.position_split(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 7, 3).select("source", "doc_id", "role")


@query("last_k_heldout", """SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 1 THEN 'heldout' ELSE 'edit' END AS role FROM conversations""")
def last_k_heldout(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    return sampling.last_k_heldout(c, ["conv_id"], "id", "turn").select("conv_id", "turn", "role")


@query("first_n_per_label", """SELECT lang, doc_id, rn::BIGINT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE lang IN ('en', 'fr')) WHERE rn <= 12""")
def first_n_per_label(spark, sf):
    wanted = literal_rows(spark, "lang", ("en",), ("fr",))
    return matrix.first_n_per_label(table(spark, sf, "documents").select("lang", "doc_id"), wanted, "lang", ["doc_id"], 12).select("lang", "doc_id", big("rn").alias("rn"))


@query("first_item_per_part", """SELECT conv_id, role, min(turn)::BIGINT AS turn FROM conversations GROUP BY conv_id, role""")
def first_item_per_part(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role", "turn")
    return matrix.first_per_group(c, ["conv_id", "role"], ["turn"]).select("conv_id", "role", big("turn").alias("turn"))


@query("worst_first_listing", """SELECT d.doc_id, round(n_chars / 100.0, 6) AS score, CASE WHEN l.doc_id IS NULL THEN 'dropped' ELSE 'scored' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def worst_first_listing(spark, sf):
    """Scores from the lowest up, with unscored cases kept and marked."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.lit(True).alias("_l"))
    rows = d.join(l, "doc_id", "left").select("doc_id", r(F.col("n_chars") / 100).alias("score"), F.when(F.col("_l"), "scored").otherwise("dropped").alias("status"))
    return rows.orderBy("score", "doc_id")


# --- text functions -----------------------------------------------------------------------

_GEN = "(" + ", ".join(f"'{v}'" for v in text.GENERIC_VALUES) + ")"


@query("generic_values", f"""WITH v AS (SELECT p_brand, CASE WHEN p_size < 10 THEN '  Not   Visible ' WHEN p_size < 20 THEN 'Green' WHEN p_size < 30 THEN p_type ELSE p_name END AS value FROM part),
n AS (SELECT *, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS s FROM v), g AS (SELECT *, (s IN {_GEN} OR len(string_split(s, ' ')) < 2) AS gen, lower(trim(value)) NOT IN ('not visible', 'none', 'n/a') AS shown FROM n)
SELECT p_brand, (count(*) FILTER (gen))::BIGINT AS n_generic, coalesce(avg(gen::INT) FILTER (shown) >= 0.5, false) AS reask FROM g GROUP BY p_brand""")
def generic_values(spark, sf):
    size = F.col("p_size")
    v = table(spark, sf, "part").select("p_brand", F.when(size < 10, "  Not   Visible ").when(size < 20, "Green").when(size < 30, F.col("p_type")).otherwise(F.col("p_name")).alias("value"))
    return v.groupBy("p_brand").agg(big(F.count_if(text.is_generic("value"))).alias("n_generic"), text.should_reask("value").alias("reask"))


@query("composite_names", """SELECT c_custkey, c_name || '|' || c_mktsegment || '|named|ip' || CASE WHEN c_nationkey % 2 = 0 THEN '0.5' ELSE 'None' END || '|seed' || c_nationkey AS image_id,
 c_name || '_' || c_mktsegment || '_named_ip' || CASE WHEN c_nationkey % 2 = 0 THEN '0.5' ELSE 'None' END || '_seed' || c_nationkey || '.png' AS file_name,
 'tpch:' || c_mktsegment || ':' || c_custkey AS hub, 'tpch' AS dataset, c_mktsegment || ':' || c_custkey AS key, printf('%05d', c_custkey) AS padded,
 replace(c_mktsegment, '_', ' ') AS common, c_mktsegment AS genus FROM customer""")
def composite_names(spark, sf):
    c = table(spark, sf, "customer")
    scale = F.when(F.col("c_nationkey") % 2 == 0, F.lit(0.5))
    c = c.withColumn("scale", scale).withColumn("mode", F.lit("named"))
    c = c.withColumn("iid", names.image_id("c_name", "c_mktsegment", "mode", "scale", "c_nationkey"))
    c = c.withColumn("hub", names.hub_key(F.lit("tpch"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")))
    ds, key = names.split_global_id("hub")
    return c.select("c_custkey", F.col("iid").alias("image_id"), names.id_to_filename("iid").alias("file_name"), "hub", ds.alias("dataset"), key.alias("key"),
                    names.padded_key("c_custkey").alias("padded"), names.common_name(F.concat(F.lit("001."), F.col("c_mktsegment"))).alias("common"),
                    names.genus(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" major"))).alias("genus"))


@query("prompt_texts", """SELECT p_partkey, 'a photo of a ' || CASE WHEN p_size % 2 = 0 THEN 'plant' ELSE p_name END AS bare,
 'a real photograph of ' || p_type || CASE WHEN lower(p_brand) <> lower(p_type) THEN ', a type of ' || p_brand || ',' ELSE '' END || ' as the main subject' AS query,
 replace(CASE p_size % 10 WHEN 0 THEN 'a {c} in soft afternoon light' WHEN 1 THEN 'a {c} photographed against a plain background' WHEN 2 THEN 'a {c} resting on a wooden table'
  WHEN 3 THEN 'a {c} outdoors on an overcast day' WHEN 4 THEN 'a {c} in sharp focus, close up' WHEN 5 THEN 'a {c} standing in an open field' WHEN 6 THEN 'a {c} lit from one side in a quiet room'
  WHEN 7 THEN 'a {c} seen from a low angle' WHEN 8 THEN 'a {c} on a bright summer morning' ELSE 'a {c} against a dark neutral backdrop' END, '{c}', p_name) AS scene FROM part""")
def prompt_texts(spark, sf):
    p = table(spark, sf, "part").withColumn("neutral", F.col("p_size") % 2 == 0)
    return p.select("p_partkey", names.bare_prompt("p_name", "neutral").alias("bare"), names.reference_query("p_type", "p_brand").alias("query"),
                    names.scene_prompt("p_name", "p_size").alias("scene"))


@query("box_arithmetic", """WITH b AS (SELECT p_partkey, (p_retailprice - 905) / 2 AS x0, p_size * 1.25 AS y0, p_size * 2.5 - 3 AS x1, (p_retailprice - 900) / 4 AS y1, 60 AS w, 50 AS h FROM part),
k AS (SELECT p_partkey, greatest(0, least(w, round_even(least(x0, x1), 0)))::BIGINT AS ax, greatest(0, least(w, round_even(greatest(x0, x1), 0)))::BIGINT AS bx,
 greatest(0, least(h, round_even(least(y0, y1), 0)))::BIGINT AS ay_, greatest(0, least(h, round_even(greatest(y0, y1), 0)))::BIGINT AS by_ FROM b)
SELECT p_partkey, ax AS x0, ay_ AS y0, bx AS x1, by_ AS y1, round(10.0 / greatest(1, (bx - ax) * (by_ - ay_)), 9) AS share FROM k""")
def box_arithmetic(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_retailprice") - 905) / 2).alias("a"), (F.col("p_size") * 1.25).alias("b"),
                                        (F.col("p_size") * 2.5 - 3).alias("c"), ((F.col("p_retailprice") - 900) / 4).alias("d"))
    k = p.select("p_partkey", names.clamp_box("a", "b", "c", "d", F.lit(60), F.lit(50)).alias("k")).select("p_partkey", "k.*")
    return k.select("p_partkey", *[big(c).alias(c) for c in ("x0", "y0", "x1", "y1")], r(names.box_share(F.lit(10), "x0", "y0", "x1", "y1"), 9).alias("share"))


@query("provenance_hashes", """SELECT doc_id, sha256(text) AS content_sha256, md5(text) AS content_md5,
 sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS entry_sha256, sha256('{"a":"' || lang || '","b":"' || source || '"}') AS policy_sha256 FROM documents""")
def provenance_hashes(spark, sf):
    d = table(spark, sf, "documents").withColumn("policy", F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.col("lang")))
    return d.select("doc_id", names.content_sha256("text").alias("content_sha256"), names.content_md5("text").alias("content_md5"),
                    names.entry_sha256(["source", "lang", "doc_id"]).alias("entry_sha256"), names.policy_sha256("policy").alias("policy_sha256"))


_REPLY = """rp AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Sure: ' || props || ' done' WHEN 1 THEN 'no json here' WHEN 2 THEN '{"k": "' || event_type || '", "s": " "}'
 WHEN 3 THEN 'x {"k": 3} and {"k": 4}' WHEN 4 THEN '[ "a", ' || user_id || ' ] tail' ELSE '{broken' END AS reply FROM events)"""


@query("json_slots", f"""WITH {_REPLY}, j AS (SELECT event_id, reply, try_cast(nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS JSON) AS obj, try_cast(nullif(regexp_extract(reply, '(?s)\\[.*\\]'), '') AS JSON) AS arr FROM rp)
SELECT event_id, coalesce(nullif(trim(obj ->> '$.k'), ''), 'not visible') AS k, coalesce(nullif(trim(obj ->> '$.s'), ''), 'not visible') AS s, coalesce(json_array_length(arr), 0)::BIGINT AS n_list FROM j""")
def json_slots(spark, sf):
    rep = _replies(table(spark, sf, "events"))
    obj = text.outer_object("reply")
    return rep.select("event_id", text.read_slot(obj, "k").alias("k"), text.read_slot(obj, "s").alias("s"), big(F.size(text.string_list("reply"))).alias("n_list"))


def _replies(e):
    i = F.col("event_id") % 6
    return e.select("event_id", F.when(i == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).when(i == 1, "no json here")
                    .when(i == 2, F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('", "s": " "}'))).when(i == 3, 'x {"k": 3} and {"k": 4}')
                    .when(i == 4, F.concat(F.lit('[ "a", '), F.col("user_id").cast("string"), F.lit(" ] tail"))).otherwise("{broken").alias("reply"))


@query("first_object_anywhere", f"""WITH {_REPLY} SELECT event_id, CASE event_id % 6 WHEN 0 THEN regexp_extract(reply, '[0-9]+') WHEN 2 THEN regexp_extract(reply, '"k": "([a-z]+)"', 1) WHEN 3 THEN '3' END AS k FROM rp""")
def first_object_anywhere(spark, sf):
    rep = _replies(table(spark, sf, "events"))
    return rep.select("event_id", F.try_variant_get(text.first_object("reply"), "$.k", "string").alias("k"))


@query("reply_validation", """WITH rp AS (SELECT conv_id, turn, (conv_id * 8 + turn) % 8 AS m, length(text) AS n FROM conversations)
SELECT conv_id, turn, m IN (0, 5, 7) AS ok, m NOT IN (0, 1, 5, 6, 7) AS degenerate, CASE WHEN m = 1 THEN 1 WHEN m = 6 THEN 2 ELSE 0 END::BIGINT AS n_issues, m = 5 AS reference_ok FROM rp""")
def reply_validation(spark, sf):
    """Judge replies of eight kinds built around the turns."""
    c = table(spark, sf, "conversations")
    n = F.length("text").cast("string")
    kinds = [
        F.lit('{"verdict": "pass", "issues": []}'),
        F.concat(F.lit('Well: {"verdict": " FAIL ", "issues": [{"concept": "wing", "problem": "'), n, F.lit('"}, {"problem": "x"}, "odd"]} :}')),
        F.lit('{"verdict": "PASS", "issues": [{"concept": "beak", "problem": "gone"}]}'),
        F.concat(F.lit("!!!! "), n, F.lit(' {"verdict": "PASS"}')),
        F.lit('{"verdict": 1, "issues": []}'),
        F.lit('{"verdict": "PASS", "reference_traits": ["a", "b", "c"], "candidate_evidence": ["1", "2", "3"], "mismatches": []}'),
        F.lit('{"verdict": "FAIL", "issues": [{"concept": "a"}, {"concept": " b "}]}'),
        F.lit('{"verdict": "PASS", "reference_traits": ["a", "b", " "], "candidate_evidence": ["1", "2", "3"]}'),
    ]
    m = (F.col("conv_id") * 8 + F.col("turn")) % 8
    reply = F.coalesce(*[F.when(m == i, k) for i, k in enumerate(kinds)])
    j = c.select("conv_id", "turn", reply.alias("reply"))
    j = j.select("conv_id", "turn", text.judge_reply("reply").alias("v"), text.reference_judge_reply("reply").alias("rv"))
    return j.select("conv_id", "turn", "v.ok", "v.degenerate", big(F.size("v.issues")).alias("n_issues"), F.col("rv.ok").alias("reference_ok"))


@query("evidence_records", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'MISSING' WHEN event_id % 3 = 1 THEN 'ABSTAIN' ELSE 'PRESENT' END AS state,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / 100, 6) END AS sim, CASE WHEN event_id % 3 = 0 THEN 'subject' ELSE event_type END AS kind FROM events""")
def evidence_records(spark, sf):
    """Evidence structs written to JSON with and without a state, and read back; some entries are bare states."""
    e = table(spark, sf, "events")
    s = e.select("event_id", F.from_json(F.to_json(F.struct((F.col("value") / 100).alias("sim"), F.col("event_type").alias("kind"), F.lit("PRESENT").alias("state"))), text.SCORE_SCHEMA).alias("s"))
    j = s.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('"MISSING"')).when(F.col("event_id") % 3 == 1, text.score_to_json("s", False))
                 .otherwise(text.score_to_json("s", True)).alias("j"))
    return j.select("event_id", text.score_from_json("j").alias("b")).select("event_id", "b.state", r("b.sim").alias("sim"), "b.kind")
