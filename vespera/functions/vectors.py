"""Vector functions as Spark columns over ARRAY<FLOAT|DOUBLE>; sums run in double, left to right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the metrics.
METRICS = ("cosine_distance", "euclidean_squared", "dot_product")
FLOAT32_MAX = 3.4028234663852886e38


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def negative_dot(a: Column, b: Column) -> Column:
    """Negative inner product: smaller is closer."""
    return -dot(a, b)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def _cosine(ab: Column, norms: Column) -> Column:
    """Null where there is no direction, or a component is missing."""
    return F.when((norms > 0) & ab.isNotNull(), F.greatest(F.lit(0.0), 1 - ab / norms))


def cosine_distance(a: Column, b: Column) -> Column:
    return _cosine(dot(a, b), l2_norm(a) * l2_norm(b))


def normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    norm = l2_norm(v)
    by = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.zip_with(_double(v), F.array_repeat(by, F.size(v)), lambda x, n: x / n)


def distance(metric: str, a: Column, b: Column) -> Column:
    forms = dict(zip(METRICS, (cosine_distance, l2_squared, negative_dot)))
    if metric not in forms:
        raise ValueError(f"unknown metric {metric!r}")
    return forms[metric](a, b)


def distance_from(metric: str, a: Column, a_sq: Column, b: Column) -> Column:
    """The distance, with the stored squared norm of a."""
    return _cosine(dot(a, b), F.sqrt(a_sq) * l2_norm(b)) if metric == "cosine_distance" else distance(metric, a, b)


def sound(distance_: Column) -> Column:
    """Whether a distance can be ranked: vectors that are null, zero (by cosine), of another length or not finite have none."""
    return distance_.isNotNull() & (F.abs(distance_) < float("inf"))


def problem(v: Column, metric: str = "cosine_distance") -> Column:
    """Null for a valid vector, else what is wrong: empty, not_finite, zero or overflow."""
    finite = F.forall(_double(v), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    out = F.when(v.isNull() | (F.size(v) < 1), "empty").when(~finite, "not_finite")
    if metric == "cosine_distance":
        out = out.when(dot(v, v) == 0, "zero").when(dot(v, v) > FLOAT32_MAX, "overflow")
    return out


def int8_scale(v: Column) -> Column:
    return F.array_max(F.transform(_double(v), lambda x: F.abs(x))) / 127.0


def int8_codes(v: Column) -> Column:
    """round(x / scale), halves away from zero, within +-127; all zero for a zero vector."""
    scale = int8_scale(v)
    safe = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    return F.zip_with(_double(v), F.array_repeat(safe, F.size(v)), lambda x, s: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x / s))).cast("int"))


def dot_int8(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def int8_distance(metric: str, a: Column, a_scale: Column, a_sq: Column, b: Column, b_scale: Column, b_sq: Column) -> Column:
    """Approximate distance from codes, scales and squared norms."""
    ab = dot_int8(a, b) * a_scale * b_scale
    if metric == "dot_product":
        return -ab
    if metric == "euclidean_squared":
        return F.greatest(F.lit(0.0), a_sq + b_sq - 2 * ab)
    return F.greatest(F.lit(0.0), 1 - ab / F.sqrt(a_sq * b_sq))


def prefix(v: Column, dims: int) -> Column:
    """The leading dimensions, for a cheaper candidate stage."""
    return F.slice(v, 1, dims)
