"""Scalar expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, margin: float = 1e-7) -> Column:
    p = F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))
    return F.log(p / (1 - p))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where undefined."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def binary_entropy(p: Column, margin: float = 1e-7) -> Column:
    """In bits."""
    p = F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def cosine_taper(d: Column, near: float = 1.4, far: float = 3.0) -> Column:
    """1 up to near, 0 from far on, half a cosine wave between."""
    return 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.greatest((d - near) / (far - near), F.lit(0.0)), F.lit(1.0))))


def fraction(x: Column) -> Column:
    """Thresholds and scores above 1 are per cent."""
    return F.when(x > 1, x / 100).otherwise(x)


def seeded_rank(seed: int | str, *parts: Column) -> Column:
    """A deterministic tie-breaking key: SHA-256 of seed and parts."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def metric_name(text: Column) -> Column:
    """Lower case, letters and digits kept, the rest joined by one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


def membership_digest(identifier: Column) -> Column:
    """Aggregate: SHA-256 of the sorted ids, one per line. Gathers the group's ids: for published memberships, not for hot keys."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(identifier)), "\n"), F.lit("\n")), 256)


def pearson(a: Column | str, b: Column | str) -> Column:
    """Aggregate: correlation, NULL where a side is constant (corr() fails there under ANSI)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
