"""Text columns: normalisation, vagueness, phrase matching, reply parsing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
GENERIC_VALUES = ("", "green", "full", "tree", "plant", "leaf", "leaves", "normal", "typical", "standard",
                  "not visible", "none", "n/a", "na", "unknown", "brown", "grey", "gray")
NOT_VISIBLE = ("not visible", "none", "n/a", "")
NOT_SHOWN = ("not visible", "none", "n/a")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
                "a pair of", "several", "many", "a few")
RELATION_WORDS = ("behind", "in front of", "next to", "beside", "above", "below", "under", "on top of", "between",
                  "inside", "outside", "left of", "right of", "beneath", "near", "against")
GARBAGE_MARK = "!!!!"
STATES = ("PRESENT", "MISSING", "FINE_MISMATCH", "ABSTAIN")
SCENE_FRAMES = (
    "a {c} in soft afternoon light",
    "a {c} photographed against a plain background",
    "a {c} resting on a wooden table",
    "a {c} outdoors on an overcast day",
    "a {c} in sharp focus, close up",
    "a {c} standing in an open field",
    "a {c} lit from one side in a quiet room",
    "a {c} seen from a low angle",
    "a {c} on a bright summer morning",
    "a {c} against a dark neutral backdrop",
)
QUERY_TYPED = "a real photograph of {concept}, a type of {coarse}, as the main subject"
QUERY_PLAIN = "a real photograph of {concept} as the main subject"
EDIT_PROMPT = ("Replace only the {coarse} with a {concept}. Preserve its pose, position, scale, viewpoint, lighting and shadows, and "
               "preserve the surrounding scene. Use the reference image only for the defining visual identity of the {concept}; do not "
               "copy its background, text, people, framing or artistic style. The result must still depict: {prompt}.")

_LETTER = "[\\p{L}\\p{N}_]"
# every character that counts as white space in Unicode text, as the inside of a class
_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(v) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(v).cast("string"), f"\\A[{_SPACE}]++|[{_SPACE}]++\\z", "")


def norm(v) -> Column:
    return F.lower(strip(v))


def squash(v) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(v), f"[{_SPACE}]+", " ")))


def is_visible(v) -> Column:
    return ~F.coalesce(norm(v), F.lit("")).isin(*NOT_VISIBLE)


def is_generic(v) -> Column:
    """In the list of vague values, or a single word."""
    s = squash(v)
    return s.isin(*GENERIC_VALUES) | (F.size(F.split(s, " ")) < 2)


def should_reask(v, threshold: float = 0.5) -> Column:
    """Aggregate: vague share of the shown values reaches the threshold; false when none are shown."""
    shown = ~norm(v).isin(*NOT_SHOWN)
    return F.coalesce(F.avg(F.when(shown, is_generic(v).cast("int"))) >= threshold, F.lit(False))


def phrase_pattern(phrase) -> Column:
    """Pattern of a word-bounded phrase with flexible inner space, for use with ``rlike``."""
    escaped = F.regexp_replace(squash(phrase), f"([^\\p{{L}}\\p{{N}}_{_SPACE}])", "\\\\$1")
    return F.concat(F.lit(f"(?<!{_LETTER})"), F.regexp_replace(escaped, " ", f"[{_SPACE}]+".replace("\\", "\\\\")), F.lit(f"(?!{_LETTER})"))


def mentions(text, phrase) -> Column:
    return F.rlike(F.lower(col(text)), phrase_pattern(phrase))


def marked_words(text) -> Column:
    """The lower-cased text with a stop word for every run of signs that belong to no word; white space is left as it is."""
    return F.regexp_replace(F.lower(col(text)), f"[^\\p{{L}}\\p{{N}}_{_SPACE}]+", " \u0001 ")


def word_tokens(text) -> Column:
    """Lower-cased words in order; every other character but space becomes a stop word of its own."""
    return F.split(strip(marked_words(text)), f"[{_SPACE}]+")


def ngrams(words, lengths) -> Column:
    """Distinct n-grams of the given lengths from a column of word tokens.

    No phrase contains the stop word, so none spans punctuation. Longer grams grow from
    the shorter ones. Pass a projected column: an expression would be evaluated per use.
    """
    tokens = col(words)
    grams, wanted = tokens, []
    for n in range(1, max(lengths) + 1):
        if n > 1:
            room = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, F.lit(1), room), F.slice(tokens, F.lit(n), room), lambda a, b: F.concat_ws(" ", a, b))
        if n in lengths:
            wanted.append(grams)
    return F.array_distinct(F.concat(*wanted))


def number_words(prompt) -> Column:
    return _found(prompt, NUMBER_WORDS)


def relation_words(prompt) -> Column:
    return _found(prompt, RELATION_WORDS)


def _found(prompt, needles) -> Column:
    low = F.lower(col(prompt))
    hits = [F.when(low.rlike(f"(?<![a-z]){n}(?![a-z])"), F.lit(n)) for n in sorted(needles)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def digit_tokens(prompt) -> Column:
    """Digit runs not touching letters, digits or underscores, first occurrence order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(prompt)), F.lit(f"(?<!{_LETTER})([0-9]+)(?!{_LETTER})"), 1))


def prompt_tags(prompt, target) -> Column:
    """Array of (kind, phrase): the target, then counts, then relations, each phrase once."""
    t = F.lower(col(target))
    kinds = F.concat(
        F.transform(number_words(prompt), lambda w: F.struct(F.lit("count").alias("kind"), w.alias("phrase"))),
        F.transform(digit_tokens(prompt), lambda w: F.struct(F.lit("count").alias("kind"), w.alias("phrase"))),
        F.transform(relation_words(prompt), lambda w: F.struct(F.lit("relation").alias("kind"), w.alias("phrase"))))
    return F.concat(F.array(F.struct(F.lit("subject").alias("kind"), col(target).alias("phrase"))),
                    F.filter(kinds, lambda k: k["phrase"] != t))


# --- replies ---------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _first_object(text: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def scan(s):
        at = s.find("{") if s is not None else -1
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(s, at)[0])
            except ValueError:
                at = s.find("{", at + 1)
        return None

    return text.map(scan)


def outer_object(text) -> Column:
    """The span from the first opening to the last closing brace as a variant, NULL if not JSON.

    The parser stops at the end of a first value; inside brackets anything after it counts.
    """
    span = F.nullif(F.regexp_extract(col(text), "(?s)\\{.*\\}", 0), F.lit(""))
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), span, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(alone) == 1, F.get(alone, F.lit(0)))


def first_object(text) -> Column:
    """The first well-formed object anywhere in a reply; the scan only runs where the outer span fails."""
    span = outer_object(text)
    rest = F.when(span.isNull() & col(text).contains("{"), col(text))
    return F.coalesce(span, F.try_parse_json(_first_object(rest)))


def read_slot(obj: Column, slot: str) -> Column:
    """A slot's text, "not visible" when missing or blank."""
    v = F.try_variant_get(obj, f"$.{slot}", "string")
    return F.when(strip(F.coalesce(v, F.lit(""))) != "", v).otherwise("not visible")


def string_list(text) -> Column:
    """The outer bracket span as an array of strings, empty when it is not a JSON list."""
    span = F.nullif(F.regexp_extract(col(text), "(?s)\\[.*\\]", 0), F.lit(""))
    items = F.try_variant_get(F.try_parse_json(span), "$", "array<variant>")
    return F.coalesce(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def judge_reply(text) -> Column:
    """struct(ok, degenerate, issues): a reply must be an object with verdict PASS or FAIL.

    The garbage mark, a missing or unknown verdict, and a PASS listing issues are degenerate;
    an issue counts if it names a concept at all, be it only white space.
    """
    obj = first_object(text)
    verdict = F.upper(strip(F.when(F.schema_of_variant(F.coalesce(F.try_variant_get(obj, "$.verdict", "variant"), F.parse_json(F.lit("null")))) == "STRING",
                                    F.try_variant_get(obj, "$.verdict", "string"))))
    listed = F.coalesce(F.try_variant_get(obj, "$.issues", "array<variant>"), F.array().cast("array<variant>"))
    named = F.filter(F.transform(listed, lambda i: F.try_variant_get(i, "$.concept", "string")), lambda c: c.isNotNull() & (c != ""))
    issues = F.transform(named, strip)
    bad = (F.contains(col(text), F.lit(GARBAGE_MARK)) | F.coalesce(~verdict.isin("PASS", "FAIL"), F.lit(True))
           | ((verdict == "PASS") & (F.size(issues) > 0)))
    return F.struct((~bad & (verdict == "PASS")).alias("ok"), bad.alias("degenerate"),
                    F.when(bad, F.array().cast("array<string>")).otherwise(issues).alias("issues"))


def reference_judge_reply(text) -> Column:
    """As ``judge_reply``, but a PASS needs three traits, evidence for each and no mismatch."""
    base, obj = judge_reply(text), first_object(text)

    def texts(name):
        listed = F.coalesce(F.try_variant_get(obj, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(listed, lambda x: (F.schema_of_variant(x) == "STRING") & (strip(F.try_variant_get(x, "$", "string")) != ""))

    n_traits, n_evidence, n_miss = F.size(texts("reference_traits")), F.size(texts("candidate_evidence")), F.size(texts("mismatches"))
    thin = base["ok"] & ((n_traits < 3) | (n_evidence < n_traits) | (n_miss > 0))
    return F.struct((base["ok"] & ~thin).alias("ok"), (base["degenerate"] | thin).alias("degenerate"))


def says_yes(reply) -> Column:
    return F.coalesce(norm(reply).startswith("yes"), F.lit(False))


# --- evidence records -------------------------------------------------------------

SCORE_SCHEMA = ("phrase string, sim double, sim_coarse double, sim_proto double, sim_proto_coarse double, "
                "candidates array<struct<box array<double>, dino_conf double, sim double, sim_coarse double, "
                "sim_proto double, sim_proto_coarse double>>, box array<double>, dino_conf double, kind string, state string")


def score_to_json(score: str, with_state: bool) -> Column:
    s = F.col(score)
    return F.to_json(s if with_state else s.dropFields("state"), {"ignoreNullFields": "false"})


def score_from_json(text) -> Column:
    """Score struct from JSON. A bare state string is an old entry; no state means ABSTAIN; an unknown one is an error."""
    t = col(text)
    bare = F.regexp_extract(t, '^\\s*"(.*)"\\s*$', 1)
    parsed = F.from_json(t, SCORE_SCHEMA)
    old = F.from_json(F.concat(F.lit('{"phrase":"","kind":"subject","state":"'), bare, F.lit('"}')), SCORE_SCHEMA)
    s = F.when(bare != "", old).otherwise(parsed)
    state = F.coalesce(s["state"], F.lit("ABSTAIN"))
    checked = F.when(state.isin(*STATES), state).otherwise(F.raise_error(F.concat(state, F.lit(" is not a verifier state"))).cast("string"))
    return s.withField("state", checked).withField("kind", F.coalesce(s["kind"], F.lit("subject")))
