"""Similarity measures in [0, 1] as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import squared_norm


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def clamp(s: Column) -> Column:
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; 0.5 where a vector is zero."""
    norms = F.sqrt(squared_norm(a) * squared_norm(b))
    return clamp((F.when(norms > 0, dot(a, b) / norms).otherwise(0.0) + 1) / 2)


def unit_cosine01(a: Column, b: Column) -> Column:
    """The same for vectors that have length 1 or 0."""
    return clamp((dot(a, b) + 1) / 2)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda total, x: total + x)


def l2_similarity(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + squared_distance(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct token arrays; 0 for two empty sets."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)

