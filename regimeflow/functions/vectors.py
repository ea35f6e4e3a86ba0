"""Expressions over ``ARRAY<DOUBLE>`` vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(sum_squares(v))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def distance(a: Column, b: Column) -> Column:
    return l2_norm(difference(a, b))


def mean_square_error(x: Column, x_hat: Column) -> Column:
    return sum_squares(difference(x, x_hat)) / F.size(x)


def distances_to(v: Column, points: Sequence[Sequence[float]]) -> Column:
    """Distance from ``v`` to each of a handful of fixed points, in order."""
    return F.transform(F.array(*[vector(p) for p in points]), lambda p: distance(v, p))


def nearest_index(dists: Column) -> Column:
    """0-based position of the smallest distance; the lowest index wins a tie."""
    return (F.array_position(dists, F.array_min(dists)) - 1).cast("int")


def distance_weights(dists: Column, temperature: float) -> Column:
    """exp(-temperature * distance), shifted by the smallest distance for stability.

    The minimum is found in the fold and used in its last step, so it is not evaluated per element.
    """
    return F.aggregate(
        dists, F.lit(float("inf")), lambda low, d: F.least(low, d),
        lambda low: F.transform(dists, lambda d: F.exp(F.lit(-float(temperature)) * (d - low))))


def normalised(weights: Column) -> Column:
    """Weights divided by their sum, which is likewise evaluated once."""
    return F.aggregate(
        weights, F.lit(0.0), lambda acc, w: acc + w,
        lambda total: F.transform(weights, lambda w: w / total))


def none_if_nan(x: Column) -> Column:
    """NaN counts as missing everywhere in this package."""
    return F.when(~F.isnan(x), x)
