"""Activation functions as column expressions.  Inputs are clipped so ``exp`` stays finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 30.0  # fixed value


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(-CLIP)), F.lit(CLIP))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped(x)))


def sigmoid_grad(x: Column) -> Column:
    s = sigmoid(x)
    return s * (F.lit(1.0) - s)


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(clipped(x)))


def softplus_grad(x: Column) -> Column:
    return sigmoid(x)


def tanh_safe(x: Column) -> Column:
    return F.tanh(clipped(x))


def tanh_grad(x: Column) -> Column:
    t = tanh_safe(x)
    return F.lit(1.0) - t * t
