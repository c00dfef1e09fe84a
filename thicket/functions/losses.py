"""Losses, gradients and link functions as column expressions.

``y`` is 0 or 1, ``v`` the raw score, ``q`` an inverse propensity (1 if there is none).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def squared_hinge_probability(v: Column) -> Column:
    m = F.greatest(F.lit(0.0), 1.0 - v)
    return F.exp(-m * m)


def softplus(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


def logistic_loss(y: Column, v: Column) -> Column:
    return softplus(v) - y * v


def logistic_grad(y: Column, v: Column) -> Column:
    return sigmoid(v) - y


def hinge_loss(y: Column, v: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - (2 * y - 1) * v)


def hinge_grad(y: Column, v: Column) -> Column:
    s = 2 * y - 1
    return F.when(s * v < 1, -s).otherwise(0.0)


def squared_hinge_loss(y: Column, v: Column) -> Column:
    m = hinge_loss(y, v)
    return m * m


def squared_hinge_grad(y: Column, v: Column) -> Column:
    s = 2 * y - 1
    return F.when(s * v < 1, -2 * s * (1 - s * v)).otherwise(0.0)


def un_logistic_loss(y: Column, v: Column, q: Column) -> Column:
    """The logistic loss with the label weighted by its inverse propensity."""
    return softplus(v) - y * q * v


def un_logistic_grad(y: Column, v: Column, q: Column) -> Column:
    return sigmoid(v) - y * q


def pw_logistic_loss(y: Column, v: Column, q: Column) -> Column:
    """Positives weighted ``2q - 1``."""
    return (2 * q - 1) * y * softplus(-v) + (1 - y) * softplus(v)


def pw_logistic_grad(y: Column, v: Column, q: Column) -> Column:
    s = sigmoid(v)
    return (1 - y) * s - (2 * q - 1) * y * (1 - s)
