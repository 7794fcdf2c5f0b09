"""Vectors as array<float>: distance, faults and the float32 norm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest float32 and smallest normal one.
FLOAT_MAX, FLOAT_MIN_NORMAL = 3.4028234663852886e38, 1.1754943508222875e-38


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine clamped to [-1, 1]; NaN with a zero vector or one that has no finite norm."""
    return cosine_distance_of(a, b, F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))


def cosine_distance_of(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """cosine_distance, with both norms (sqrt(dot(x, x))) reckoned before."""
    norm = norm_a * norm_b
    cosine = dot(a, b) / F.when(norm > 0, norm)
    return F.when((norm > 0) & ~F.isnan(cosine), 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).otherwise(F.lit(float("nan")))


def float32_square_norm(e: Column) -> Column:
    """Sum of squares in float32 steps, subnormals flushed to zero."""
    flush = lambda x: F.when(F.abs(x) < F.lit(FLOAT_MIN_NORMAL).cast("float"), F.lit(0.0).cast("float")).otherwise(x)
    squares = F.transform(e.cast("array<float>"), lambda x: flush(flush(x) * flush(x)))
    return F.aggregate(squares, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


def degenerate(e: Column) -> Column:
    """Whether the float32 norm is 0, so that no direction is left."""
    return float32_square_norm(e) <= F.lit(0.0).cast("float")


def vector_fault(e: Column, width: int) -> Column:
    """The first fault of a vector (array<double>), or null: missing, width, value, zero norm."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > FLOAT_MAX)
    return (
        F.when(e.isNull(), F.lit("missing"))
        .when(F.size(e) != width, F.lit("width"))
        .when(F.exists(e, wrong), F.lit("value"))
        .when(degenerate(e), F.lit("zero norm"))
    )


def hash_embedding(text: Column, width: int) -> Column:
    """A deterministic test vector: byte pairs of SHA-256 digests, centred, scaled to unit length. Stands in for a model in tests."""
    digest = lambda i: F.sha2(F.concat(text, F.lit("#"), i.cast("string")), 256)
    value = lambda i: F.conv(F.substring(digest(i), 1, 4), 16, 10).cast("double") / 65535.0 - 0.5
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: (x / norm).cast("float"))
