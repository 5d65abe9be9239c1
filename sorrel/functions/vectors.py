"""Vector columns as ``array<double>``: dot, norm, cosine, reference weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a, b) -> Column:
    """Left-to-right sum of products; NULL if either side is NULL."""
    return F.aggregate(F.zip_with(as_vector(a), as_vector(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def _once(value, body) -> Column:
    """``body`` of a value evaluated once: inside a lambda an outer expression would rerun per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v, strict: bool = False) -> Column:
    """L2-normalised vector. A zero vector stays unchanged, or raises when ``strict``."""
    def scaled(vec):
        def by(n):
            if strict:
                ok = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < F.lit(float("inf")))
                other = F.raise_error(F.lit("embedding must have a finite non-zero norm")).cast("array<double>")
            else:
                ok, other = n > 0, vec
            return F.when(ok, F.transform(vec, lambda x: x / n)).otherwise(other)

        return _once(norm(vec), by)

    return _once(as_vector(v), scaled)


def cosine(a, b) -> Column:
    """Cosine of two raw vectors; 0 when either has zero length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def reference_weights(n_own, n_borrowed, own_per=2.0, borrowed_per=1.0, cap=0.7) -> Column:
    """Weights for own then borrowed references, summing to 1, borrowed mass at most ``cap``."""
    own, bor = F.col(n_own).cast("int"), F.col(n_borrowed).cast("int")
    own_mass, bor_mass = own * own_per, bor * borrowed_per
    total = own_mass + bor_mass
    share = F.when(total > 0, bor_mass / F.nullif(total, F.lit(0.0)))
    capped = (own > 0) & (bor > 0) & (share > cap)
    bor_w = F.when(capped, F.lit(cap) / F.nullif(bor, F.lit(0))).otherwise(F.lit(borrowed_per) / F.nullif(total, F.lit(0.0)))
    own_w = F.when(capped, F.lit(1 - cap) / F.nullif(own, F.lit(0))).otherwise(F.lit(own_per) / F.nullif(total, F.lit(0.0)))
    return F.concat(F.array_repeat(own_w, own), F.array_repeat(bor_w, bor))
