"""Caption corpora: phrase counts, samples, class ranking, densities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.text import marked_words, mentions, ngrams, norm, squash, word_tokens
from sorrel.operators.sampling import corpus_sample
from sorrel.session import widen

#: Bytes of concepts, counted, up to which they are sent to every task.
_BROADCAST_BYTES = 32 << 20


def _mentioned(spark: SparkSession, phrases: list[tuple[str, str, bool]]):
    """A column function: the concepts whose phrase stands between spaces in a text of words, each once, with the flag given."""
    sent = spark.sparkContext.broadcast(phrases)

    def find(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton, concepts = ahocorasick.Automaton(), {}
        for phrase, concept, flag in sent.value:
            concepts.setdefault(f" {phrase} ", []).append((concept, flag))
        for phrase, named in concepts.items():
            automaton.add_word(phrase, tuple(named))
        automaton.make_automaton()
        for batch in lines:
            out = []
            for text in batch:
                # white space is here what it is in the texts' patterns
                line = f" {' '.join(text.as_py().split())} " if text.is_valid else ""
                # a phrase names the same tuple wherever it stands: tuples are made one before they are opened
                out.append([{"concept": c, "odd": odd} for c, odd in sorted({x for named in {named for _, named in automaton.iter(line)} for x in named})])
            yield pa.array(out, kind)

    kind = pa.list_(pa.struct([("concept", pa.string()), ("odd", pa.bool_())]))
    return F.arrow_udf(find, "array<struct<concept:string,odd:boolean>>")


def phrase_matches(captions: DataFrame, concepts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, concept) for every caption mentioning a concept as a whole word or phrase.

    While the counted bytes of the concepts are few, one automaton of all of them goes over each
    caption's words once, and only mentions become rows; no caption is shuffled. Beyond that texts become
    distinct n-grams of the lengths the concepts have, joined by a shuffle. Concepts with other signs than letters,
    digits and spaces are matched by pattern against the captions having their first word.
    """
    odd = F.col("_phrase").rlike("[^\\p{L}\\p{N}_ ]")
    # keys are NULL where they do not apply, so that no pattern filter is inferred for the n-grams
    c = concepts.select("concept").distinct().withColumn("_phrase", squash("concept")).select(
        "concept", F.when(~odd, F.col("_phrase")).alias("_plain"), F.when(odd, F.regexp_extract("_phrase", "[\\p{L}\\p{N}_]+", 0)).alias("_head"),
        F.size(F.split("_phrase", " ")).alias("_len"))
    size = c.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("_plain").isNotNull(), F.col("_len"))).alias("lengths"), F.count("_head").alias("odd"),
        F.coalesce(F.sum(2 * F.octet_length("concept") + 64), F.lit(0)).alias("bytes")).first()
    found = captions.select(ident).limit(0).withColumn("concept", F.lit(None).cast("string"))
    if size["bytes"] <= _BROADCAST_BYTES:
        sought = c.select(F.coalesce("_plain", "_head").alias("p"), "concept", F.col("_plain").isNull().alias("odd")).where("p <> '' OR NOT odd").collect()
        if not sought:
            return found
        lines = widen(captions.select(ident, text)).select(ident, F.col(text).cast("string").alias("_text"), marked_words(text).alias("_line"))
        named = lines.select(ident, "_text", _mentioned(lines.sparkSession, [tuple(r) for r in sought])("_line").alias("_named"))
        sure = F.filter("_named", lambda x: ~x["odd"] | mentions("_text", x["concept"])) if size["odd"] else F.col("_named")
        return named.select(ident, F.explode(sure["concept"]).alias("concept"))
    words = widen(captions.select(ident, text)).select(ident, word_tokens(text).alias("_words"))
    if size["lengths"]:
        grams = words.select(ident, F.explode(ngrams("_words", sorted(size["lengths"]))).alias("_gram"))
        found = grams.join(c.select("_plain", "concept"), F.col("_gram") == F.col("_plain")).select(ident, "concept")
    if size["odd"]:
        # candidates first, without the text: only they are joined back to it
        heads = words.select(ident, F.explode(ngrams("_words", [1])).alias("_gram"))
        near = heads.join(c.select("_head", "concept"), F.col("_gram") == F.col("_head")).select(ident, "concept")
        found = found.unionByName(near.join(captions.select(ident, text), ident).where(mentions(text, "concept")).select(ident, "concept"))
    return found


def caption_counts(captions: DataFrame, concepts: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """Captions mentioning each concept, 0 included."""
    n = phrase_matches(captions, concepts, ident, text).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    return concepts.select("concept").distinct().join(n, "concept", "left").select("concept", F.coalesce("n", F.lit(0)).alias("n"))


def select_rows(captions: DataFrame, concepts: DataFrame, ident: str, n_per_concept: int, n_random: int, seed, text: str = "text") -> DataFrame:
    """The corpus: a slice per concept plus random bulk, each row once."""
    return corpus_sample(captions, phrase_matches(captions, concepts, ident, text), ident, n_per_concept, n_random, seed)


def rank_classes(counts: DataFrame, groundable: DataFrame, exclude: DataFrame, n: int, min_count: int = 1, rare: bool = False) -> DataFrame:
    """The ``n`` most (or least) counted groundable classes outside ``exclude``, names break ties."""
    pool = groundable.select("concept").distinct().join(exclude.select("concept").distinct(), "concept", "left_anti")
    pool = pool.join(counts, "concept", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") >= min_count)
    return pool.orderBy(F.col("n").asc() if rare else F.col("n").desc(), "concept").limit(n)


def merged_concepts(*sets: DataFrame) -> DataFrame:
    """Case-insensitive union of concept lists."""
    out = None
    for s in sets:
        low = s.select(norm("concept").alias("concept"))
        out = low if out is None else out.unionByName(low)
    return out.distinct()


def density_summary(counts: DataFrame, own: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """One row: own concepts below k matches, candidates at or above k, candidates in all."""
    lows = lambda d: d.select(norm("concept").alias("concept")).distinct().join(counts, "concept", "left")
    thin = lows(own).agg(F.count_if(F.coalesce("n", F.lit(0)) < k).alias("n_thin"))
    clear = lows(candidates).agg(F.count_if(F.col("n") >= k).alias("n_cleared"), F.count(F.lit(1)).alias("n_candidates"))
    return thin.join(F.broadcast(clear))


def caption_files(images: DataFrame, captions: DataFrame, stem: str = "stem") -> DataFrame:
    """Images left-joined to their caption sidecars; an unreadable sidecar counts as no caption."""
    j = images.join(captions, stem, "left")
    return j.agg(F.count(F.lit(1)).alias("n_images"), F.count("caption").alias("n_captioned"))
