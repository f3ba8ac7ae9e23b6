"""Exponential weights of all prunings of a tree, and what each leaf predicts with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.impurity import log_mean
from ..functions.storage import stored


def rate(step: float | Column) -> Column:
    return step if isinstance(step, Column) else F.lit(float(step))


def log_weights(nodes: DataFrame, step: float | Column = 1.0, keys: Sequence[str] = ("tree",)) -> DataFrame:
    """Adds log_weight_tree: -step * loss at a leaf, and above it the log mean of a node's own weight and the product of its
    children's. nodes: keys, path, depth, is_leaf and loss_valid. Works upwards, one depth after another."""
    keys = list(keys)
    own = nodes.withColumn("_own", -rate(step) * F.col("loss_valid"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done, below = [], None
    for d in range(deepest, -1, -1):
        at = own.where(F.col("depth") == d)
        if below is None:
            level = at.withColumn("log_weight_tree", F.col("_own"))
        else:
            kids = below.groupBy(*keys, F.expr("substring(path, 1, length(path) - 1)").alias("path")).agg(F.sum("log_weight_tree").alias("_kids"))
            level = at.join(kids, [*keys, "path"], "left").withColumn("log_weight_tree", F.when(F.col("is_leaf"), F.col("_own")).otherwise(log_mean(F.col("_own"), F.col("_kids")))).drop("_kids")
        if deepest - d >= 3 and d:
            level = stored(level, "weights")
        done.append(level)
        below = level.select(*keys, "path", "log_weight_tree")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("_own")


def leaf_predictions(nodes: DataFrame, step: float | Column = 1.0, aggregation: bool = True, keys: Sequence[str] = ("tree",)) -> DataFrame:
    """A row for each leaf: leaf_id, prediction (an array) and weighted_depth.

    A node v above the leaf takes the share a = exp(-step * loss_v - log_weight_v) / 2 of what the nodes above it have left,
    and the leaf takes the rest. Each leaf is joined with the nodes on its path, of which there are as many as its depth.
    """
    keys = list(keys)
    leaves = nodes.where("is_leaf").select(*keys, F.col("path").alias("leaf"), F.col("node_id").alias("leaf_id"), F.col("depth").alias("leaf_depth"))
    if not aggregation:
        return nodes.where("is_leaf").select(*keys, "path", F.col("node_id").alias("leaf_id"), F.col("y_pred").alias("prediction"), F.col("depth").cast("double").alias("weighted_depth"))
    path = leaves.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.col("leaf_depth")), lambda d: F.substring(F.col("leaf"), F.lit(1), d))))
    share = F.when(F.col("is_leaf"), F.lit(1.0)).otherwise(0.5 * F.exp(-rate(step) * F.col("loss_valid") - F.col("log_weight_tree")))
    steps = path.join(nodes.select(*keys, "path", "depth", "is_leaf", "loss_valid", "log_weight_tree", "y_pred"), [*keys, "path"])
    steps = steps.groupBy(*keys, "leaf", "leaf_id").agg(F.array_sort(F.collect_list(F.struct("depth", share.alias("a"), "y_pred"))).alias("steps"))
    start = F.struct(F.lit(1.0).alias("left"), F.transform(F.col("steps")[0]["y_pred"], lambda _: F.lit(0.0)).alias("p"), F.lit(0.0).alias("d"))
    fold = F.aggregate(
        "steps",
        start,
        lambda s, x: F.struct(
            (s["left"] * (1 - x["a"])).alias("left"),
            F.zip_with(s["p"], x["y_pred"], lambda p, y: p + s["left"] * x["a"] * y).alias("p"),
            (s["d"] + s["left"] * x["a"] * x["depth"]).alias("d"),
        ),
    )
    got = steps.withColumn("s", fold)
    return got.select(*keys, F.col("leaf").alias("path"), "leaf_id", F.col("s.p").alias("prediction"), F.col("s.d").alias("weighted_depth"))
