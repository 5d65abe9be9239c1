"""Language identification by rank-order profiles.

A language's profile lists its most frequent letter n-grams by rank, a document's the same way.
The distance is the sum of how far each n-gram of the document is out of place in the
language's list; an n-gram that is not listed costs the list's length. The nearest language
wins, the alphabetically first one on ties.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sorrel.llm.common import texts_of
from sorrel.session import cut

#: N-grams in a profile.
PROFILE = 300
#: Labelled documents that a language's profile is learned from, about as many at most.
TRAIN_DOCS = 3000
#: N-grams from which a text is long enough to be told from gibberish, and the share of a usual low score that it must reach.
TELLING, LOW_SHARE = 60, 0.6
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED, _LONG = 100_000, 40
#: Words of a text whose n-grams are counted at once, so a text of any length needs bounded memory.
_WORDS_AT_ONCE = 1 << 16


class _Grams(dict):
    """N-grams of one to three letters of a word, with its ends marked; frequent words are remembered."""

    def __init__(self):
        self.same: dict[str, str] = {}

    def __missing__(self, word: str) -> tuple[str, ...]:
        marked = f"_{word}_"
        grams = chain(word, map("".join, zip(marked, marked[1:])), map("".join, zip(marked, marked[1:], marked[2:])))
        if len(word) > _LONG:
            return tuple(grams)
        if len(self) >= _REMEMBERED:
            self.clear()
            self.same.clear()
        same = self.same
        found = self[word] = tuple(same.setdefault(g, g) for g in grams)
        return found


def gram_counts(text: str | None, grams: _Grams) -> Counter:
    return Counter(chain.from_iterable(map(grams.__getitem__, _WORD.findall((text or "").lower()))))


def ranked(counts: Counter, size: int = PROFILE) -> list[str]:
    """The most frequent n-grams, ties in text order."""
    if len(counts) > size:
        values = np.fromiter(counts.values(), np.int64, len(counts))
        least = int(np.partition(values, len(values) - size)[len(values) - size])
        items = [(-n, g) for g, n in counts.items() if n >= least]
    else:
        items = [(-n, g) for g, n in counts.items()]
    items.sort()
    return [g for _, g in items[:size]]


def _number(gram: str) -> int:
    """An n-gram of at most three letters as a number; numbers are ordered as the n-grams are."""
    return sum((ord(c) + 1) << at for c, at in zip(gram, (42, 21, 0)))


def _numbers(words: list[str]) -> np.ndarray:
    """The numbers of all n-grams of some words, repeats included."""
    a = np.frombuffer(f"_{'__'.join(words)}_".encode("utf-32-le"), "<u4").astype(np.int64) + 1
    letter = a != _number("_") >> 42
    # two marks in a row stand between two words, which no n-gram spans
    inside = letter[:-1] | letter[1:]
    one = a << 42
    two = one[:-1] | a[1:] << 21
    return np.concatenate([one[letter], two[inside], (two[:-1] | a[2:])[inside[:-1] & inside[1:]]])


def ranked_numbers(text: str | None, size: int = PROFILE, words_at_once: int = _WORDS_AT_ONCE) -> np.ndarray:
    """What ``ranked`` of the text's counts gives, as numbers: words are cut and counted together."""
    words = _WORD.findall((text or "").lower())
    numbers, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(words), words_at_once):
        more, n = np.unique(_numbers(words[lo:lo + words_at_once]), return_counts=True)
        if lo:
            more, place = np.unique(np.concatenate([numbers, more]), return_inverse=True)
            old, n = np.concatenate([counts, n]), np.zeros(len(more), np.int64)
            np.add.at(n, place, old)
        numbers, counts = more, n
    return numbers[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of every listed n-gram in every language."""

    def __init__(self, profiles: dict[str, list[str]], size: int = PROFILE):
        self.languages = sorted(profiles)
        self.size = size
        # rows in the order of the numbers
        listed = sorted({g for p in profiles.values() for g in p}, key=_number)
        self.row = {g: i for i, g in enumerate(listed)}
        self.numbers = np.array([_number(g) for g in listed], np.int64)
        self.ranks = np.full((len(listed), len(self.languages)), 1 << 30, np.int64)
        for j, language in enumerate(self.languages):
            for r, g in enumerate(profiles[language]):
                self.ranks[self.row[g], j] = r

    def nearest(self, document: list[str]) -> tuple[str, float]:
        """(language, score): score is one less the share of the greatest possible distance."""
        return self.nearest_numbers(np.array([_number(g) for g in document], np.int64))

    def nearest_numbers(self, document: np.ndarray) -> tuple[str, float]:
        """``nearest`` of n-grams given as numbers."""
        if not len(document) or not self.languages:
            return UNKNOWN, 0.0
        distance = np.full(len(self.languages), len(document) * self.size, np.int64)
        if len(self.numbers):
            row = np.minimum(np.searchsorted(self.numbers, document), len(self.numbers) - 1)
            rank = np.flatnonzero(self.numbers[row] == document)
            distance -= self.size * len(rank)
            distance += np.minimum(np.abs(self.ranks[row[rank]] - rank[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (len(document) * self.size)


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int) -> DataFrame:
    """(_lang, _text) of about ``train_docs`` rows a language, picked by a hash of the id.

    The chosen ids, at most that many a language, go to the texts; no text is shuffled.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    names = rows.select("_id", "_lang")
    per_lang = names.groupBy("_lang").agg((F.lit(float(train_docs)) / F.count(F.lit(1))).alias("_share"))
    dice = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / 1e6
    chosen = names.where(F.col("_id").isNotNull()).join(per_lang, "_lang").where(dice < F.col("_share")).select("_id", "_lang").distinct()
    return rows.join(F.broadcast(chosen), ["_id", "_lang"], "left_semi").select("_lang", "_text")


def learn_profiles(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, size: int = PROFILE, train_docs: int | None = TRAIN_DOCS) -> Profiles:
    """Profiles from rows with a language: all of them, or about ``train_docs`` a language, picked by a hash of the id.

    What reaches the driver is ``size`` n-grams for each language.
    """
    if train_docs is None:
        sample = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
            F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    else:
        sample = _sample(labelled, id_col, text_col, lang_col, train_docs)

    def counted(words: dict[str, Counter], grams: _Grams) -> pa.RecordBatch:
        out = []
        for lang, seen in words.items():
            found: Counter = Counter()
            for word, n in seen.items():
                for g in grams[word]:
                    found[g] += n
            out += [(lang, g, n) for g, n in found.items()]
        lang, gram, n = zip(*out) if out else ((), (), ())
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = _Grams(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                words.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
                # words are counted first, so that frequent ones are cut into n-grams once
                if sum(map(len, words.values())) > _REMEMBERED:
                    yield counted(words, grams)
                    words = {}
        yield counted(words, grams)

    counts = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    profiles: dict[str, list[str]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, size)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) per row of ``docs``.

    Profiles are learned from the rows that are not held out by their id; rows with a null id
    are predicted but not learned from. Null text and text without a letter, and every text
    when there is nothing to learn from, give ``und`` with score 0.
    """
    training = docs.where(~held_out(id_col) & F.col(id_col).isNotNull())
    profiles = learn_profiles(training, id_col, text_col, lang_col)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), held_out(id_col).alias("_held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest_numbers(ranked_numbers(t)) for t in texts_of(batch)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return base.mapInArrow(run, T.StructType([
        T.StructField(id_col, base.schema["_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def _fits(profiles: Profiles, texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """(score, grams) of texts: how well the nearest language fits, and how many n-grams tell it."""
    for batch in texts:
        score, grams = [], []
        for t in batch:
            ranks = ranked_numbers(t.as_py())
            score.append(profiles.nearest_numbers(ranks)[1])
            grams.append(len(ranks))
        yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(grams, pa.int32())], ["score", "grams"])


def keep_identified(docs: DataFrame, min_score: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    train_docs: int | None = None) -> DataFrame:
    """The documents that read as one of the languages of the corpus; every column stays.

    A document goes if it has no letter, or if it has ``TELLING`` n-grams at least and they lie so far
    out of place in every language that its score is below ``min_score``. Unless given, that is
    ``LOW_SHARE`` of the score that all but a hundredth of the rows reach which the profiles are learned from:
    all that are not held out and have a language, unless ``train_docs`` limits the profiles' rows.
    Every text is scored once, and written with its score.
    """
    learned = ~held_out(id_col) & F.col(id_col).isNotNull()
    profiles = learn_profiles(docs.where(learned), id_col, text_col, lang_col, train_docs=train_docs)

    def fits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # one number, used in one place: NULL without a letter or language, 2 for a text too short to tell
        for found in _fits(profiles, texts):
            score, grams = (found.field(i).to_numpy() for i in range(2))
            yield pa.array(np.where(grams < TELLING, 2.0, score), pa.float64(), mask=~((grams > 0) & (score > 0.0)))

    scored = cut(docs.withColumn("_language_fit", F.arrow_udf(fits, "double")(F.col(text_col).cast("string"))))
    if min_score is None:
        known = scored.where(learned & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        low = known.agg(F.percentile_approx(F.when(F.col("_language_fit") < 2.0, F.col("_language_fit")), 0.01, 10_000)).first()[0]
        min_score = LOW_SHARE * (low or 0.0)
    return scored.where(F.col("_language_fit") >= min_score).drop("_language_fit")
