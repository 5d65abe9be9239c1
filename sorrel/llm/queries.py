"""Registered queries of the text operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm import chat, language, lexical, merkle, negatives, neighbours, packing, pieces, pii, repeats, sharding, simhash, toxicity
from sorrel.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_TREE = r"""list_transform(string_split({}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '(?:[\x09-\x0D\x20]*[^\x09-\x0D\x20]+){{1,8}}|[\x09-\x0D\x20]+'), lambda w: md5(w))))"""
_ROOT = """sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(list_transform(s,
    lambda p: sha256(array_to_string(p, ''))), ''))), ''))"""
_LIKE = """CASE WHEN r{0} = r{1} THEN 1.0::DOUBLE WHEN len(l{0}) + len(l{1}) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(l{0}, l{1})) / (len(l{0}) + len(l{1})) END"""
_PARTS = "list_transform(flatten({}), lambda p: sha256(array_to_string(p, '')))"


@query("op1_merkle_fingerprints", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 3) || substring(nxt, 1, length(text) // 3) AS edited FROM n),
t AS (SELECT *, {_TREE.format('text')} AS ta, {_TREE.format('edited')} AS te, {_TREE.format('nxt')} AS tn FROM e),
r AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_PARTS.format('ta')} AS pa, {_PARTS.format('te')} AS pe,
  {', '.join(f"{_ROOT.format('t' + x)} AS r{x}, list_distinct(flatten(flatten(t{x}))) AS l{x}" for x in 'aen')} FROM t)
SELECT doc_id, n_chars, edited_sha256, ra AS fingerprint, re AS edited_fingerprint, {_LIKE.format('a', 'e')} AS near_edited, {_LIKE.format('a', 'n')} AS near_next,
  list_min(list_filter(range(greatest(len(pa), len(pe))), lambda i: pa[i + 1] IS DISTINCT FROM pe[i + 1])) AS first_edit FROM r""")
def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(read_table(spark, sf_dir, "documents"))


@query("op2_ordinal_toxicity")
def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


@query("op3_kmeans_tree_search")
def op3_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return neighbours.search(rows.where(F.col("vec_id") % 20 == 0), rows, k=20)


_ESC = r"regexp_replace({}, '(<|\[)(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"


@query("op4_prefix_target_chat", rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<s>[INST]' || {_ESC.format('role')} || '[/INST]' || {_ESC.format('text')} || '</s>') AS chars
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR place = n THEN prefix ELSE 0 END)::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id""")
def op4_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.expand(rows))


@query("op5_simhash_golay")
def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_rank_order_language")
def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(read_table(spark, sf_dir, "documents"))


@query("op7_vector_packing")
def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


_BID = "1.0 / -ln((('0x' || substring(md5(doc_id::VARCHAR || '/' || '{0}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
# CRC-32 bit by bit, lowest bit of each byte first
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex({0}), '..'),
  lambda h: [((('0x' || h)::BIGINT) >> k) & 1 for k in range(8)]))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""


@query("op8_rendezvous_sharding", f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents),
b AS (SELECT *, [{', '.join(_BID.format(s) for s in range(16))}] AS bids, {_BID.format(16)} AS grown FROM r),
s AS (SELECT *, (list_position(bids, list_max(bids)) - 1)::INTEGER AS shard FROM b)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  (CASE WHEN grown > list_max(bids) THEN 16 ELSE shard END)::INTEGER AS grown_shard FROM s""")
def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read_table(spark, sf_dir, "documents"))


@query("op9_piece_backtracking")
def op9_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_repeated_windows", """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(n_bytes - 399)) AS p FROM d WHERE n_bytes >= 400)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
x AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS words, regexp_extract_all(text, '\\S+\\s*') AS spaced FROM documents WHERE text IS NOT NULL),
xw AS (SELECT doc_id, p, md5(array_to_string(words[p + 1:p + 51], ' ')) AS k FROM (SELECT *, unnest(range(len(words) - 50)) AS p FROM x WHERE len(words) > 50)),
xr AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM xw) WHERE n > 1),
xg AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 51 THEN 0 ELSE 1 END AS fresh FROM xr)),
xs AS (SELECT doc_id, min(p) AS a, max(p) + 51 AS b FROM xg GROUP BY doc_id, run),
xl AS (SELECT doc_id, count(*) AS n_passages, sum(list_sum(list_transform(spaced[a + 1:b - 1], lambda u: strlen(u))) + strlen(words[b]))::BIGINT AS passage_bytes
  FROM xs JOIN x USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_passages, 0) AS n_passages, coalesce(passage_bytes, 0) AS passage_bytes, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(len(starts) + 1), lambda i: substr(h,
    2 * CASE WHEN i = 0 THEN 0 ELSE ends[i] END + 1, 2 * (CASE WHEN i = len(starts) THEN n_bytes ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ends[i] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN xl USING (doc_id)""")
def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(read_table(spark, sf_dir, "documents"), threshold=400, words=51)


@query("op11_residue_negatives", """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER w::INTEGER AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 5""")
def op11_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(rows.where(F.col("vec_id") % 100 == 0), rows)


@query("op12_anchored_pii")
def op12_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""


@query("op13_bit_sliced_search", f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM w JOIN t USING (term) JOIN l USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER r::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10""")
def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))
