"""Impurities, forecasts and losses as column expressions over sums.

A node is summed up by its moments: for classes, the weight of each; for regression, the sums of w, wy and wyy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITERIA = {"gini": "class", "entropy": "class", "mse": "value"}


def added(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def weight_of(moments: list[Column], criterion: str) -> Column:
    return moments[0] if criterion == "mse" else added(moments)


def impurity(moments: list[Column], criterion: str) -> Column:
    """gini: 1 - sum p^2; entropy: -sum p ln p (nats); mse: E y^2 - (E y)^2. Null for no weight."""
    w = weight_of(moments, criterion)
    if criterion == "gini":
        value = 1 - added([m * m for m in moments]) / (w * w)
    elif criterion == "entropy":
        value = -added([F.when(m > 0, m / w * F.log(m / w)).otherwise(0.0) for m in moments])
    elif criterion == "mse":
        value = moments[2] / w - (moments[1] / w) * (moments[1] / w)
    else:
        raise ValueError(f"Unknown criterion: {criterion}")
    return F.when(w > 0, value)


def gain_proxy(w_left: Column, left: Column, w_right: Column, right: Column) -> Column:
    """What orders splits of one node as the information gain does."""
    return -w_left * left - w_right * right


def information_gain(w: Column, node: Column, w_node: Column, w_left: Column, left: Column, w_right: Column, right: Column) -> Column:
    """The weighted drop of impurity by a split; w: the weight of all rows."""
    return w_node / w * (node - w_left / w_node * left - w_right / w_node * right)


def forecast(moments: list[Column], criterion: str, dirichlet: float | Column = 0.5) -> Column:
    """An array: the smoothed share of each class, or the mean alone."""
    if criterion == "mse":
        return F.array(F.when(moments[0] > 0, moments[1] / moments[0]).otherwise(0.0))
    a = dirichlet if isinstance(dirichlet, Column) else F.lit(float(dirichlet))
    total = added(moments) + a * len(moments)
    return F.array(*((m + a) / total for m in moments))


def loss(moments: list[Column], predicted: list[Column], criterion: str) -> Column:
    """The log loss or squared error summed over rows with these moments, if all are given the same forecast."""
    if criterion == "mse":
        p = predicted[0]
        return moments[2] - 2 * p * moments[1] + p * p * moments[0]
    return added([F.when(m > 0, -m * F.log(p)).otherwise(0.0) for m, p in zip(moments, predicted, strict=True)])


def log_mean(a: Column, b: Column) -> Column:
    """log((e^a + e^b) / 2) without overflow."""
    return F.greatest(a, b) + F.log((1 + F.exp(-F.abs(a - b))) / 2)
