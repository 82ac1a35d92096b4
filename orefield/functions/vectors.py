"""Expressions over arrays of doubles and over sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(squared_sum(F.zip_with(a, b, lambda x, y: x - y)))


def normalised_distance(point: Column, centroid: Column, deviation: Column) -> Column:
    """Diagonal Mahalanobis distance; a deviation of 0 divides by 1."""
    scaled = F.zip_with(F.zip_with(point, centroid, lambda x, c: x - c), deviation, lambda d, s: d / F.when(s == 0, 1.0).otherwise(s))
    return F.sqrt(squared_sum(scaled))


def jaccard(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard index from the sizes of intersection and sets."""
    return shared / (size_a + size_b - shared)
