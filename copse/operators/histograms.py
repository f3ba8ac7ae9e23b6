"""Histograms of nodes, and the best split of each node by cumulative scans over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash48
from ..functions.impurity import gain_proxy, impurity, weight_of

NODE = ["tree", "path"]


def moments_of(criterion: str, n_classes: int, w: str = "w", y: str = "y") -> list[Column]:
    """What each row adds to the moments of its node."""
    if criterion == "mse":
        return [F.col(w), F.col(w) * F.col(y), F.col(w) * F.col(y) * F.col(y)]
    return [F.when(F.col(y) == k, F.col(w)).otherwise(0.0) for k in range(n_classes)]


def sums_of(rows: DataFrame, criterion: str, n_classes: int) -> list[Column]:
    """moments_of(); rows that stand for several have wy and wyy if the criterion is mse (see Forest.fit)."""
    return [F.col("w"), F.col("wy"), F.col("wyy")] if "wyy" in rows.columns else moments_of(criterion, n_classes)


def rows_where(rows: DataFrame, side: Column) -> Column:
    """How many rows are on a side; a row may stand for n."""
    return F.sum(F.when(side, F.col("n")).otherwise(0)) if "n" in rows.columns else F.count_if(side)


def names_of(criterion: str, n_classes: int) -> list[str]:
    return [f"m{i}" for i in range(3 if criterion == "mse" else n_classes)]


def node_totals(assign: DataFrame, criterion: str, n_classes: int) -> DataFrame:
    """A row for each node: rows and weights in and out of the bag, and the moments of either (arrays)."""
    parts = sums_of(assign, criterion, n_classes)
    inside = F.col("is_train")
    return assign.groupBy(*NODE).agg(
        rows_where(assign, inside).alias("n_samples_train"),
        rows_where(assign, ~inside).alias("n_samples_valid"),
        F.sum(F.when(inside, F.col("w")).otherwise(0.0)).alias("w_samples_train"),
        F.sum(F.when(~inside, F.col("w")).otherwise(0.0)).alias("w_samples_valid"),
        F.array(*(F.sum(F.when(inside, p).otherwise(0.0)) for p in parts)).alias("w_train_k"),
        F.array(*(F.sum(F.when(~inside, p).otherwise(0.0)) for p in parts)).alias("w_valid_k"),
    )


def histograms(rows: DataFrame, criterion: str, n_classes: int) -> DataFrame:
    """A row for each node, feature and bin that has rows. rows: assigned rows with `features`, what their node looks at.

    Spark sums each task's rows up before the shuffle, so what is shuffled is bounded by nodes, features and bins.
    """
    parts = sums_of(rows, criterion, n_classes)
    inside = F.col("is_train")
    cells = rows.select(*NODE, "is_train", *(c for c in ("n", "w", "y", "wy", "wyy") if c in rows.columns), "bins", F.posexplode("features").alias("f_rank", "feature")).withColumn("bin", F.get("bins", F.col("feature")))
    return cells.groupBy(*NODE, "feature", "f_rank", "bin").agg(
        rows_where(rows, inside).alias("n_train"),
        rows_where(rows, ~inside).alias("n_valid"),
        F.sum(F.when(~inside, F.col("w")).otherwise(0.0)).alias("w_valid"),
        *(F.sum(F.when(inside, p).otherwise(0.0)).alias(m) for p, m in zip(parts, names_of(criterion, n_classes), strict=True)),
    )


def scanned(hist: DataFrame, categorical: Sequence[bool], criterion: str, n_classes: int, strategy: str = "binary", seed: int = 0) -> DataFrame:
    """The histogram in the order in which each feature's bins go to the left.

    Numbers: by bin. Categories: by the share of class 1 ("binary"), of each class in turn ("all", a scan each), or of a
    class drawn for the node and feature ("random"); in regression by the sum of wy ("binary") or its mean ("mean"). Bins
    without rows in the bag come last: they stay right.
    """
    names = names_of(criterion, n_classes)
    w = weight_of([F.col(m) for m in names], criterion)
    flags = F.array(*(F.lit(bool(c)) for c in categorical))
    hist = hist.withColumn("is_cat", F.get(flags, F.col("feature")))
    share = lambda m: F.when(w > 0, F.col(m) / w)
    if criterion == "mse":
        keyed, key = hist.withColumn("scan", F.lit(0)), F.when(w > 0, F.col("m1") / w if strategy == "mean" else F.col("m1"))
    elif strategy == "all" and n_classes > 2:
        keyed = hist.withColumn("scan", F.explode(F.when(F.col("is_cat"), F.sequence(F.lit(0), F.lit(n_classes - 1))).otherwise(F.array(F.lit(0)))))
        key = F.get(F.array(*(share(m) for m in names)), F.col("scan"))
    elif strategy == "random":
        k = F.pmod(hash48(seed, "class", F.col("tree"), F.col("path"), F.col("feature")), F.lit(n_classes)).cast("int")
        keyed, key = hist.withColumn("scan", F.lit(0)), F.get(F.array(*(share(m) for m in names)), k)
    else:
        keyed, key = hist.withColumn("scan", F.lit(0)), share(names[min(1, n_classes - 1)])
    return keyed.withColumn("key", F.when(F.col("is_cat"), F.coalesce(F.when(F.col("n_train") > 0, key), F.lit(float("inf")))).otherwise(F.col("bin").cast("double")))


def candidates(scans: DataFrame, criterion: str, n_classes: int, *, min_samples_leaf: int = 1, aggregation: bool = True) -> DataFrame:
    """A row for each place at which a scan can be cut, with its gain and what goes to either side."""
    names = names_of(criterion, n_classes)
    group = Window.partitionBy(*NODE, "feature", "scan")
    upto = group.orderBy("key", "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = scans.select("*", *(F.sum(c).over(upto).alias(f"{c}_l") for c in (*names, "n_train", "n_valid", "w_valid")), *(F.sum(c).over(group).alias(f"{c}_a") for c in (*names, "n_train", "n_valid", "w_valid")))
    left, right = [F.col(f"{m}_l") for m in names], [F.col(f"{m}_a") - F.col(f"{m}_l") for m in names]
    ok = (F.col("n_train") > 0) & (F.col("n_train_l") >= min_samples_leaf) & (F.col("n_train_a") - F.col("n_train_l") >= min_samples_leaf)
    if aggregation:
        ok &= (F.col("n_valid_l") >= min_samples_leaf) & (F.col("n_valid_a") - F.col("n_valid_l") >= min_samples_leaf)
    cut = sums.where(ok & (weight_of(left, criterion) > 0) & (weight_of(right, criterion) > 0))
    cut = cut.withColumn("impurity_left", impurity(left, criterion)).withColumn("impurity_right", impurity(right, criterion))
    gain = gain_proxy(weight_of(left, criterion), F.col("impurity_left"), weight_of(right, criterion), F.col("impurity_right"))
    return cut.withColumn("gain", gain)


def best_splits(scans: DataFrame, criterion: str, n_classes: int, *, min_samples_leaf: int = 1, aggregation: bool = True) -> DataFrame:
    """A row for each node that can be split: by highest gain, then the feature drawn first, then the earliest place.

    Returns feature, bin_threshold (the last bin to go left, in scan order), is_split_categorical, bin_partition (for
    categories, all bins that go left, sorted), gain and the children's impurities.
    """
    cut = candidates(scans, criterion, n_classes, min_samples_leaf=min_samples_leaf, aggregation=aggregation)
    order = F.struct(-F.col("gain"), "f_rank", "scan", "key", "bin")
    best = cut.groupBy(*NODE).agg(F.min_by(F.struct("feature", "scan", "key", F.col("bin").alias("bin_threshold"), F.col("is_cat").alias("is_split_categorical"), "gain", "impurity_left", "impurity_right"), order).alias("b")).select(*NODE, "b.*")
    inside = scans.where("is_cat and n_train > 0").select(*NODE, "feature", "scan", F.col("key").alias("k"), "bin")
    sets = best.where("is_split_categorical").join(inside, [*NODE, "feature", "scan"]).where((F.col("k") < F.col("key")) | ((F.col("k") == F.col("key")) & (F.col("bin") <= F.col("bin_threshold"))))
    sets = sets.groupBy(*NODE).agg(F.array_sort(F.collect_set("bin")).alias("bin_partition"))
    return best.join(sets, NODE, "left").drop("scan", "key")


def goes_left(bin_: Column) -> Column:
    """Whether a row goes to the left child of its node's split; all that is not in a category split's set goes right."""
    return F.when(F.col("is_split_categorical"), F.array_contains("bin_partition", bin_)).otherwise(bin_ <= F.col("bin_threshold"))


def routed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """The rows of split nodes, each at its child: the path gets 1 for left, 0 for right."""
    keep = rows.columns
    got = rows.join(splits.select(*NODE, "feature", "bin_threshold", "is_split_categorical", "bin_partition"), NODE)
    step = F.when(goes_left(F.get("bins", F.col("feature"))), F.lit("1")).otherwise(F.lit("0"))
    return got.withColumn("path", F.concat("path", step)).select(*keep)


