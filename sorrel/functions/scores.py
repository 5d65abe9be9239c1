"""Closed-form score columns: ratios, confusion metrics, intervals, exact binomial tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """True when the value is neither NULL, NaN nor infinite."""
    v = col(c).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def ratio(num, den, empty=0.0) -> Column:
    """num / den as double; ``empty`` (0, NaN or None) when the denominator is zero."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d != 0, F.try_divide(n, d)).otherwise(F.lit(empty).cast("double"))


def counts(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn aggregates; positive means FAIL."""
    return [F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
            F.count_if(~truth & ~predicted).alias("tn"), F.count_if(truth & ~predicted).alias("fn")]


def mcc(tp, fp, tn, fn) -> Column:
    tp, fp, tn, fn = (col(c).cast("double") for c in (tp, fp, tn, fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den != 0, F.try_divide(tp * tn - fp * fn, den)).otherwise(F.lit(0.0))


def confusion_metrics(empty=0.0) -> dict[str, Column]:
    """Metric columns over tp, fp, tn, fn columns. MCC is 0 on an empty denominator always."""
    recall = ratio("tp", col("tp") + col("fn"), empty)
    specificity = ratio("tn", col("tn") + col("fp"), empty)
    precision = ratio("tp", col("tp") + col("fp"), empty)
    n = col("tp") + col("fp") + col("tn") + col("fn")
    return {
        "n": n, "precision": precision, "recall": recall, "specificity": specificity,
        "false_positive_rate": ratio("fp", col("fp") + col("tn"), empty),
        "f1": F.when(precision + recall > 0, F.try_divide(2 * precision * recall, precision + recall)).otherwise(F.lit(0.0)),
        "accuracy": ratio(col("tp") + col("tn"), n, empty), "balanced_accuracy": (recall + specificity) / 2,
        "mcc": mcc("tp", "fp", "tn", "fn"),
    }


def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval clipped to [0, 1]; (0, 1) when n is zero."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    denom = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / denom
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / denom
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))
    return low, high


def _log_factorial(k: Column) -> Column:
    """log k! by Stirling's series, for the counts beyond a few hundred that need it."""
    x = k.cast("double") + 1.0
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))


def binomial_two_sided(b, c) -> Column:
    """Exact two-sided sign test on discordant counts (1 when there are none).

    The tail up to min(b, c) is summed over its largest terms only: those more than some twelve
    standard deviations below the count add nothing that a double can hold. The first of them
    is taken from Stirling's series, unless the sum starts at zero anyway.
    """
    lo = F.least(col(b), col(c)).cast("long")
    n = (col(b) + col(c)).cast("long")
    # log C(n, i) grows by log((n - i) / (i + 1)); each term is scaled by 2^-n at the end
    begin = F.greatest(F.lit(0).cast("long"), lo - F.ceil(12 * F.sqrt(n.cast("double")) + 200))
    steps = F.when(lo > begin, F.sequence(begin, lo - 1)).otherwise(F.array().cast("array<bigint>"))
    first = F.when(begin == 0, F.lit(0.0)).otherwise(_log_factorial(n) - _log_factorial(begin) - _log_factorial(n - begin))
    start = F.struct(first.alias("log"), F.exp(first - n * math.log(2.0)).alias("sum"))
    acc = F.aggregate(
        steps, start,
        lambda s, i: F.struct(
            (s["log"] + F.log((n - i).cast("double") / (i + 1).cast("double"))).alias("log"),
            (s["sum"] + F.exp(s["log"] + F.log((n - i).cast("double") / (i + 1).cast("double")) - n * math.log(2.0))).alias("sum")))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * acc["sum"]))


@F.pandas_udf(T.DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    """P(Z > z), on one row per group."""
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def signed_rank_upper_tail(n: pd.Series, w: pd.Series) -> pd.Series:
    """Exact P(W >= w) of the signed-rank sum for n untied pairs, on one row per group."""
    cache: dict[int, list[int]] = {}

    def tail(size, stat):
        if size not in cache:
            ways = [1]
            for rank in range(1, size + 1):
                grown = ways + [0] * rank
                for i, v in enumerate(ways):
                    grown[i + rank] += v
                ways = grown
            cache[size] = ways
        ways = cache[size]
        return sum(ways[int(math.ceil(stat)):]) / 2.0 ** size

    return pd.Series([None if pd.isna(a) or pd.isna(b) else tail(int(a), float(b)) for a, b in zip(n, w)], dtype="float64")


#: Pairs times rank sums up to which the distribution is built pair by pair.
_PAIRWISE = 20_000_000
#: Log modulus below which a frequency adds nothing that a double can hold; ranks that judge an interval; parts of a cut.
_SILENT, _JUDGES, _PARTS = -80.0, 512, 16


def _pairwise_tail(twice: np.ndarray, pairs: np.ndarray, least: int) -> float:
    """P(sum >= least): each pair adds its rank or nothing, so the distribution grows by one shifted copy of itself a pair."""
    chance = np.ones(1)
    for rank, n in zip(twice.tolist(), pairs.tolist()):
        for _ in range(n):
            grown = np.zeros(len(chance) + rank)
            grown[:len(chance)] += chance / 2
            grown[rank:] += chance / 2
            chance = grown
    return float(chance[least:].sum())


def _audible(twice: np.ndarray, pairs: np.ndarray, spread: np.ndarray, period: int):
    """Arrays of frequencies k in 1 to (period - 1) / 2 at which the transform may exceed ``exp(_SILENT)``.

    An interval of frequencies goes when the bound of its modulus over some of the ranks is that low:
    every factor is at most 1, so any ranks do, and a sine moves no faster than its angle.
    """
    stack = [(np.array([1]), np.array([(period - 1) // 2]))]
    weight, turn = pairs * spread * twice.astype(float), math.pi / period
    while stack:
        lo, hi = stack.pop()
        if len(lo) > 1024:
            stack += [(lo[1024:], hi[1024:])]
            lo, hi = lo[:1024], hi[:1024]
        half = float((hi - lo).max()) / 2 * turn
        own = np.flatnonzero(twice * half <= 0.1)
        if len(own) > _JUDGES:
            heavy = np.argpartition(-weight[own], _JUDGES // 2)[:_JUDGES // 2]
            own = own[np.unique(np.r_[heavy, np.linspace(0, len(own) - 1, _JUDGES // 2).astype(np.int64)])]
        if len(own):
            sine = np.abs(np.sin(np.outer((lo + hi) / 2, twice[own] * turn))) - (half * twice[own] + 1e-6)
            bound = (0.5 * np.log1p(-np.minimum(spread[own] * np.maximum(sine, 0.0) ** 2, 1 - 1e-15)) * pairs[own]).sum(axis=1)
            lo, hi = lo[bound > _SILENT], hi[bound > _SILENT]
        short = hi - lo < _PARTS
        if short.any():
            k = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[short].tolist(), hi[short].tolist())])
            yield from (k[i:i + 4096] for i in range(0, len(k), 4096))
        lo, hi = lo[~short], hi[~short]
        if len(lo):
            edges = lo[:, None] + (hi + 1 - lo)[:, None] * np.arange(_PARTS + 1)[None, :] // _PARTS
            stack.append((edges[:, :-1].ravel(), edges[:, 1:].ravel() - 1))


def _transform(k: np.ndarray, twice: np.ndarray, pairs: np.ndarray, p: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies that stay audible, transform of the sum there) where a pair's rank is added with chance ``p``."""
    value, at, step = np.ones(len(k), complex), 0, 256
    order = np.argsort(np.arange(len(twice)) * 0.6180339887498949 % 1.0, kind="stable")  # every stretch holds ranks of all sizes
    while at < len(order) and len(k):
        own = order[at:at + min(step, max(1, 4_000_000 // len(k)))]
        at, step = at + len(own), step * 2
        r, n = twice[own], pairs[own]
        # whole turns are dropped in whole numbers
        angle = (k[:, None] * r[None, :] % period) * (2 * math.pi / period)
        factor = 1.0 + p[own] * (np.exp(1j * angle) - 1.0)
        value *= np.prod(factor[:, n == 1], axis=1)
        if (n > 1).any():
            with np.errstate(divide="ignore"):
                value *= np.exp((np.log(factor[:, n > 1]) * n[n > 1]).sum(axis=1))
        loud = np.abs(value) > math.exp(_SILENT)
        k, value = k[loud], value[loud]
    return k, value


def signed_rank_tail(twice: np.ndarray, pairs: np.ndarray, stat: float) -> float:
    """Exact P(W >= stat) for ``pairs[i]`` pairs of rank ``twice[i] / 2`` each.

    Up to some hundred pairs the distribution is built. Beyond, it is inverted from its
    transform, tilted so that the sum asked for is the mean, which keeps small tails to many
    digits. The transform is silent but at some multiple of sqrt(n) of its about n * n frequencies.
    """
    order = np.argsort(twice)
    twice, pairs = np.asarray(twice, np.int64)[order], np.asarray(pairs, np.int64)[order]
    unit = int(np.gcd.reduce(twice))
    twice, least = twice // unit, max(0, math.ceil(math.ceil(2 * stat) / unit))
    total, n = int((twice * pairs).sum()), int(pairs.sum())
    if total * n <= _PAIRWISE:
        return _pairwise_tail(twice, pairs, least)
    if least <= 0 or least > total:
        return float(least <= 0)
    if 2 * least <= total:
        return 1.0 - signed_rank_tail(twice, pairs, (total - least + 1) / 2)
    if least == total:
        return 2.0 ** -n
    chance = lambda tilt: 1.0 / (1.0 + np.exp(-tilt * twice))
    low, high = 0.0, 1.0 / float(twice.max())
    while (chance(high) * twice * pairs).sum() < least and high < 700.0:
        low, high = high, high * 2
    for _ in range(80):
        tilt = (low + high) / 2
        low, high = (tilt, high) if (chance(tilt) * twice * pairs).sum() < least else (low, tilt)
    p, period = chance(tilt), total + 1 + total % 2
    if period * int(twice.max()) >= 2 ** 62:
        raise ValueError(f"{n} pairs are too many for an exact p")
    length = total - least + 1
    summed = float(length) if tilt == 0 else -math.expm1(-tilt * length) / -math.expm1(-tilt)
    for k in _audible(twice, pairs, 4 * p * (1 - p), period):
        k, value = _transform(k, twice, pairs, p, period)
        turned = lambda x: np.exp(-2j * math.pi / period * np.array([i * x % period for i in k.tolist()], float))
        q = np.exp(-tilt - 2j * math.pi / period * k)
        ends = 1.0 - math.exp(-tilt * length) * turned(length)
        summed += 2 * float((value * turned(least) * ends / (1.0 - q)).real.sum())
    log = float(((tilt * twice + np.log1p(np.exp(-tilt * twice)) - math.log(2.0)) * pairs).sum()) - tilt * least
    return min(1.0, max(0.0, summed / period * math.exp(log)))


@F.pandas_udf(T.DoubleType())
def exact_signed_rank_tail(ranks: pd.Series, w: pd.Series) -> pd.Series:
    """P(W >= w) of the signed-rank sum over the given ranks, ties included, on one row per group.

    ``ranks`` holds (twice the rank, how many pairs have it).
    """
    def tail(groups, stat):
        return signed_rank_tail(np.array([g["twice"] for g in groups]), np.array([g["n"] for g in groups]), stat)

    return pd.Series([None if g is None or pd.isna(x) else tail(g, float(x)) for g, x in zip(ranks, w)], dtype="float64")


def finite_score(value: str) -> Column:
    """A score as a double; NULL, NaN and infinity are errors, so no row is lost or ranked highest."""
    v = F.col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{value} is not a finite number: "), F.coalesce(v.cast("string"), F.lit("NULL")))).cast("double")).otherwise(v)
