"""Growth of all trees together, one depth after another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.impurity import forecast, loss
from ..functions.storage import dropped, sent_if_small, stored
from .histograms import NODE, best_splits, histograms, node_totals, routed, scanned
from .sampling import depth_cap, sampled_features


@dataclass
class Rules:
    """How trees are grown; see Forest for what the fields mean."""

    criterion: str
    n_classes: int
    categorical: Sequence[bool]
    k_features: int
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    aggregation: bool = True
    cat_split_strategy: str = "binary"
    randomized_depth: bool = False
    dirichlet: float = 0.5
    seed: int = 0


def grow(assign: DataFrame, rules: Rules) -> DataFrame:
    """The nodes of all trees. assign: a row for each tree and row, with tree, path (empty), is_train, w, y and bins;
    or one for n rows alike in all but w, with their sum of w, and for mse those of wy and wyy in place of y.

    Each round works on all nodes of one depth: their totals, which of them are to be split, histograms over the features
    drawn for them, the best splits, and the rows' way to the children. The rows of finished nodes drop out. A node is
    named by its path from the root, 1 for left and 0 for right. A table for each depth cuts the lineage, and goes when the
    next is there (that of `assign` too); the driver sees counts only.
    """
    frontier = None
    levels: list[DataFrame] = []
    depth = 0
    while True:
        totals = node_totals(assign, rules.criterion, rules.n_classes)
        cur = totals.withColumn("impurity", F.lit(float("inf"))) if frontier is None else totals.join(frontier, NODE)
        still = (F.col("n_samples_train") >= rules.min_samples_split) & (F.col("impurity") > 0)
        if rules.criterion == "mse":  # what rounding leaves of a constant's variance
            mean = F.get("w_train_k", 1) / F.get("w_train_k", 0)
            still &= F.col("impurity") > 1e-12 * mean * mean
        if rules.aggregation:
            still &= F.col("n_samples_valid") >= rules.min_samples_split
        if rules.max_depth is not None:
            still &= F.lit(depth < rules.max_depth)
        if rules.randomized_depth:
            still &= F.lit(depth) < depth_cap(rules.seed, F.col("tree"))
        cur = stored(cur.withColumn("open", still), "totals")
        opened = cur.where("open").select(*NODE, sampled_features(rules.seed, len(rules.categorical), rules.k_features).alias("features"))
        n_open = opened.count()
        if not n_open:
            levels.append(cur.drop("open"))
            break
        hist = stored(histograms(assign.join(sent_if_small(opened, n_open), NODE), rules.criterion, rules.n_classes), "histograms")
        scans = scanned(hist, rules.categorical, rules.criterion, rules.n_classes, rules.cat_split_strategy, rules.seed)
        best = stored(best_splits(scans, rules.criterion, rules.n_classes, min_samples_leaf=rules.min_samples_leaf, aggregation=rules.aggregation), "splits")
        levels.append(cur.drop("open").join(best, NODE, "left"))
        sides = F.explode(F.array(F.struct(F.lit("1").alias("side"), F.col("impurity_left").alias("impurity")), F.struct(F.lit("0").alias("side"), F.col("impurity_right").alias("impurity"))))
        frontier = best.select("tree", "path", sides.alias("c")).select("tree", F.concat("path", "c.side").alias("path"), "c.impurity")
        before, assign = assign, stored(routed(assign, sent_if_small(best, n_open)), "assigned")
        dropped(before)
        dropped(hist)
        depth += 1
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x, allowMissingColumns=True)
    for c, kind in (("feature", "int"), ("bin_threshold", "int"), ("is_split_categorical", "boolean"), ("bin_partition", "array<int>"), ("gain", "double"), ("impurity_left", "double"), ("impurity_right", "double")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    return finished(stored(nodes, "nodes"), rules.criterion, rules.n_classes, rules.dirichlet)


def finished(nodes: DataFrame, criterion: str, n_classes: int, dirichlet: float) -> DataFrame:
    """Adds what follows from the totals and the paths: ids, links, depth, forecast and loss.

    Ids count the nodes of a tree in the order of their paths, which is parents first, and right children before left.
    """
    ids = F.row_number().over(Window.partitionBy("tree").orderBy("path")) - 1
    named = nodes.withColumn("node_id", ids)
    key = named.select("tree", F.col("path").alias("p"), F.col("node_id").alias("id"))
    up = key.select("tree", F.col("p").alias("up"), F.col("id").alias("parent"))
    named = named.withColumn("up", F.when(F.length("path") > 0, F.expr("substring(path, 1, length(path) - 1)"))).join(up, ["tree", "up"], "left").drop("up")
    for side, name in (("1", "left_child"), ("0", "right_child")):
        down = key.where(F.col("p").endswith(side)).select("tree", F.expr("substring(p, 1, length(p) - 1)").alias("path"), F.col("id").alias(name))
        named = named.join(down, NODE, "left")
    named = named.withColumn("is_leaf", F.col("feature").isNull()).withColumn("is_left", F.col("path").endswith("1")).withColumn("depth", F.length("path"))
    return stored(with_losses(named, criterion, n_classes, dirichlet), "named")


def with_losses(nodes: DataFrame, criterion: str, n_classes: int, dirichlet: float | Column) -> DataFrame:
    """Adds y_pred and loss_valid, from the moments alone: no rows are needed to change the smoothing."""
    m = 3 if criterion == "mse" else n_classes
    train, valid = ([F.get(c, i) for i in range(m)] for c in ("w_train_k", "w_valid_k"))
    out = nodes.withColumn("y_pred", forecast(train, criterion, dirichlet))
    return out.withColumn("loss_valid", loss(valid, [F.get("y_pred", i) for i in range(1 if criterion == "mse" else m)], criterion))
