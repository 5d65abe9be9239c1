"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) is the logistic function of threshold k less the document's score. One weight a
feature serves all thresholds, so rare high grades borrow strength from the common low ones.
The expected severity is the sum over k of P(grade > k).

Features are a document's distinct lower-case words and their first four and five letters,
each present or absent, named by a 64-bit hash. The fit takes a bounded sample of labelled
rows (``TRAIN_ROWS``) and shrinks the weights of features that tell nothing to zero, so
documents of any length are scored by the few features that are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm.common import sliced, texts_of
from sorrel.session import cut, drop_tables

#: Labelled documents that the fit uses, about as many at most for each label.
TRAIN_ROWS = 3000
#: Expected severity from which a document is rejected.
REJECT = 0.4
#: Documents of the sample a feature must occur in.
LEAST_DOCS = 3

_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 200_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first four and five letters."""
    names = [word, "^" + word[:4], "^" + word[:5]]
    return tuple(xxhash.xxh64_intdigest(n) - (1 << 63) for n in dict.fromkeys(names))


def features(text: str | None) -> set[int]:
    return set(chain.from_iterable(map(word_features, set(_WORD.findall((text or "").lower())))))


class OrdinalModel:
    """Weights by feature, shared by all thresholds, and the rising thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self._known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        known, weights, hits = self._known, self.weights, set()
        for word in set(_WORD.findall((text or "").lower())):
            found = known.get(word)
            if found is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                found = known[word] = tuple(f for f in word_features(word) if f in weights)
            if found:
                hits.update(found)
        return sum(weights[f] for f in sorted(hits))

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return _logistic(score - self.thresholds)

    def severity(self, text: str | None) -> tuple[float, int]:
        """(expected severity, most probable grade); a text without a word has no severity."""
        if not _WORD.search(text or ""):
            return 0.0, 0
        p = self.above(self.score(text))
        each = -np.diff(np.r_[1.0, p, 0.0])
        return float(p.sum()), int(np.argmax(each))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def loss_and_gradients(row: np.ndarray, col: np.ndarray, grade: np.ndarray, w: np.ndarray, theta: np.ndarray):
    """Mean negative log-likelihood and its gradients by weight and by threshold."""
    n, k = len(grade), len(theta)
    eta = np.bincount(row, w[col], n)
    edges = np.r_[-np.inf, theta, np.inf]
    with np.errstate(over="ignore"):
        upper, lower = 1 / (1 + np.exp(eta - edges[grade + 1])), 1 / (1 + np.exp(eta - edges[grade]))
    inside = np.maximum(upper - lower, 1e-12)
    by_eta = 1.0 - upper - lower
    by_theta = np.zeros(k + 2)
    np.add.at(by_theta, grade + 1, -upper * (1 - upper) / inside)
    np.add.at(by_theta, grade, lower * (1 - lower) / inside)
    return -np.log(inside).mean(), np.bincount(col, by_eta[row], len(w)) / n, by_theta[1:-1] / n


def fit(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, grades: int, shrink: float = 5e-4, steps: int = 250,
        rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal gradient steps with a running scale per parameter."""
    w = np.zeros(n_features)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, theta)]
    for t in range(1, steps + 1):
        _, gw, gt = loss_and_gradients(row, col, grade, w, theta)
        moved = []
        for p, g, s in ((w, gw, state[0]), (theta, gt, state[1])):
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.99 * s[1] + 0.01 * g * g
            scale = np.sqrt(s[1] / (1 - 0.99 ** t)) + 1e-4
            moved.append((p - rate * s[0] / (1 - 0.9 ** t) / scale, rate / scale))
        w = np.sign(moved[0][0]) * np.maximum(np.abs(moved[0][0]) - moved[0][1] * shrink, 0)
        theta = np.maximum.accumulate(moved[1][0] + 1e-6 * np.arange(grades - 1))
    return w, theta


def grades_of(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, n_features: int) -> np.ndarray:
    """Grades 0 to 2 from 0/1 labels: a toxic document is of grade 2 if it bears more features
    typical of toxic documents than the median toxic document, else of grade 1."""
    pos, neg = np.bincount(col[toxic[row] == 1], minlength=n_features), np.bincount(col[toxic[row] == 0], minlength=n_features)
    odds = np.log((pos + 0.5) / (1 + (toxic == 1).sum())) - np.log((neg + 0.5) / (1 + (toxic == 0).sum()))
    hits = np.bincount(row, odds[col] > 2.0, len(toxic))
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, np.where(hits > middle, 2, 1), 0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grade_col: str | None = None,
          where: Column | None = None, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on labelled documents; a hash of the id picks about ``train_rows`` of each label.

    ``grade_col`` names ready grades 0, 1, 2, ... in ``labels``; without it they come from the
    0/1 label. Rows with a null id or label are not learned from; an id labelled more
    than once has its highest label, one with several texts the first of them. With no row to
    learn from, or one label only, every document is of grade 0.
    """
    labels = labels.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_of"), F.col(grade_col or label_col).cast("int").alias("_label")).where(F.col("_label") >= 0)
    if where is not None:
        labels = labels.where(where)
    labels = labels.groupBy("_of").agg(F.max("_label").alias("_label"))
    per_label = labels.groupBy("_label").agg((F.lit(float(train_rows)) / F.count(F.lit(1))).alias("_share"))
    dice = F.pmod(F.xxhash64(F.col("_of").cast("string")), F.lit(1_000_000)) / 1e6
    chosen = labels.join(per_label, "_label").where(dice < F.col("_share")).select("_of", "_label")
    # the chosen ids are few whatever the input, so they go to the texts and not the texts to them
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_of")).groupBy("_of", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.fromiter(sorted(f), np.int64, len(f)) for f in map(features, texts_of(batch))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["label", "found"])

    # only features of LEAST_DOCS documents reach the driver
    owned: list[str] = []
    rows = cut(sample.mapInArrow(run, "label int, found array<long>").withColumn("row", F.monotonically_increasing_id()), owned)
    each = rows.select("row", F.explode("found").alias("f"))
    kept = each.join(each.groupBy("f").count().where(F.col("count") >= LEAST_DOCS).select("f"), "f", "left_semi")
    table = rows.select("row", "label").join(kept.groupBy("row").agg(F.collect_list("f").alias("found")), "row", "left").select("label", "found").toArrow()
    drop_tables(docs.sparkSession, owned)
    label = table.column("label").to_numpy().astype(np.int64)
    found = table.column("found").combine_chunks()
    size = np.asarray(found.value_lengths().fill_null(0)) if len(label) else np.zeros(0, np.int64)
    flat = found.flatten().to_numpy() if len(label) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(label)), size)
    ids, col, docs_with = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(docs_with >= LEAST_DOCS) - 1
    use = docs_with[col] >= LEAST_DOCS
    row, col, ids = row[use], number[col[use]], ids[docs_with >= LEAST_DOCS]
    if len(np.unique(label)) < 2:
        return OrdinalModel({}, np.array([np.inf]))
    # rows arrive in any order: sort, so that sums do not depend on it
    grade = label if grade_col else grades_of(label, row, col, len(ids))
    order = np.lexsort((row, col))
    w, theta = fit(row[order], col[order], grade, len(ids), max(2, int(grade.max()) + 1))
    return OrdinalModel({int(f): float(x) for f, x in zip(ids, w) if x}, theta)


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(id, expected_severity, grade, toxic) per row of ``docs``.

    Null text and text without a word are of severity and grade 0.
    Repeated rows and null ids are rows like any other; an empty table gives none.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            found = [own.severity(t) for t in texts_of(batch)]
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([g for _, g in found], pa.int32()),
                                   pa.array([s >= reject for s, _ in found])], [id_col, "expected_severity", "grade", "toxic"])

    return base.mapInArrow(run, T.StructType([
        T.StructField(id_col, base.schema["_id"].dataType), T.StructField("expected_severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]))


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The documents below ``reject``; every column and repeated row stays."""
    weights, thresholds = model.weights, model.thresholds

    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = OrdinalModel(weights, thresholds)
        for batch in texts:
            yield pa.array([own.severity(t.as_py())[0] < reject for t in batch], pa.bool_())

    return docs.where(F.arrow_udf(clean, "boolean")(F.col(text_col).cast("string")))
