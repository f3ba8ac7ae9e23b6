"""Labels, weights, bootstrap samples and splits of rows, all by hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.hashing import hash48

#: Trees whose draws of a row are counted in one long, with so many bits each: a row drawn 4096 times has a chance under 10 ** -13000.
PACKED, BITS = 5, 12


def classes_of(df: DataFrame, label: str) -> list:
    """The distinct labels, sorted; there should be no more than classes."""
    return [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def label_code(label: str, classes: Sequence[object]) -> Column:
    """The position of the label among the sorted classes; null for any other label."""
    return (F.nullif(F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)), F.lit(0)) - 1).cast("int")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """A row (label, class_weight) for each class: n / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # a row for each class
    return counts.select(label, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("class_weight"))


def one_vs_rest(df: DataFrame, label_code_col: str, n_classes: int) -> DataFrame:
    """Each row once for each class k, with y: whether the row is of that class."""
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))).withColumn("y", (F.col(label_code_col) == F.col("k")).cast("int"))


def redrawn(n_rows: int, trees: int, seed: int) -> dict[int, int]:
    """The trees whose draws hit every row, and at which further attempt they leave one out of the bag.

    That happens in small tables only: beyond 40 rows its chance is under 10 ** -16. A single row can't be left out.
    """
    out = {}
    for tree in range(trees if 1 < n_rows <= 40 else 0):
        for attempt in range(1000):
            tail = f"|{attempt}" if attempt else ""
            if len({int(md5(f"{seed}|{tree}|{i}{tail}".encode()).hexdigest()[:12], 16) % n_rows for i in range(n_rows)}) < n_rows:
                break
        if attempt:
            out[tree] = attempt
    return out


def bootstrap(df: DataFrame, n_rows: int, trees: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """A row (tree, id, n_drawn) for each tree and row that its n_rows draws with replacement hit.

    Draws are hashes of (seed, tree, draw), so that a rerun draws the same rows. df has dense ids from 0. The draws are
    counted map-side before they are shuffled.
    """
    return draws(df.select(F.col(id_col).alias("draw")), n_rows, trees, seed, id_col).groupBy("tree", id_col).agg(F.count(F.lit(1)).cast("int").alias("n_drawn"))


def draws(numbers: DataFrame, n_rows: int, trees: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """A row (tree, id) for each tree and each number (draw)."""
    each = numbers.crossJoin(F.broadcast(numbers.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))))
    h = hash48(seed, F.col("tree"), F.col("draw"))
    for tree, attempt in redrawn(n_rows, trees, seed).items():
        h = F.when(F.col("tree") == tree, hash48(seed, F.col("tree"), F.col("draw"), attempt)).otherwise(h)
    return each.select("tree", F.pmod(h, F.lit(n_rows)).alias(id_col))


def drawn_by_row(spark: SparkSession, n_rows: int, trees: int, seed: int) -> tuple[DataFrame, Column]:
    """A row for each row_id that any tree draws, and a column over it: an array of how often each tree draws it.

    Counts of PACKED trees share a long. Draws are shuffled by row alone, a row and tree being drawn about once.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = draws(spark.range(n_rows).select(F.col("id").alias("draw")), n_rows, trees, seed).repartition(tasks, "row_id")
    one = F.get(F.array(*(F.lit(1 << i * BITS).cast("long") for i in range(PACKED))), F.col("tree") % PACKED)
    packs = range(-(-trees // PACKED))
    got = each.groupBy("row_id").agg(*(F.sum(F.when(F.floor(F.col("tree") / PACKED) == g, one).otherwise(0)).alias(f"_drawn{g}") for g in packs))
    count = lambda t: F.shiftright(F.coalesce(f"_drawn{t // PACKED}", F.lit(0)), t % PACKED * BITS).bitwiseAND((1 << BITS) - 1).cast("int")
    return got, F.array(*(count(t) for t in range(trees)))


def bags(df: DataFrame, n_rows: int, trees: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """Each row of df once for each tree, with n_drawn: 0 for rows out of the tree's bag."""
    grid = df.crossJoin(F.broadcast(df.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))))
    drawn = bootstrap(df, n_rows, trees, seed, id_col)
    return grid.join(drawn, ["tree", id_col], "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)))


def max_features(given: object, d: int) -> int:
    """How many of d features a node looks at."""
    if given is None:
        return d
    if given in ("auto", "sqrt"):
        return max(1, int(math.sqrt(d)))
    if given == "log2":
        return max(1, int(math.log2(d)))
    if isinstance(given, int) and not isinstance(given, bool) and 1 <= given <= d:
        return given
    if isinstance(given, float) and 0 < given <= 1:
        return max(1, int(given * d))
    raise ValueError(f"max_features can't be {given!r} with {d} features")


def sampled_features(seed: int, d: int, k: int, tree: str = "tree", path: str = "path") -> Column:
    """k of the features 0 to d - 1, without replacement, in the order of their hashes."""
    ranks = F.array_sort(F.array(*(F.struct(hash48(seed, F.col(tree), F.col(path), f).alias("h"), F.lit(f).alias("f")) for f in range(d))))
    return F.transform(F.slice(ranks, 1, k), lambda x: x["f"])


def depth_cap(seed: int, tree: Column) -> Column:
    """A random largest depth for a tree, 3 to 50."""
    return (F.pmod(hash48(seed, "depth", tree), F.lit(48)) + 3).cast("int")


def stratified_split(df: DataFrame, label: str | None, key: str, test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """Adds is_test: of each label, the floor(test_share * rows) rows of least hash; without a label, of all rows.

    The hash below which rows are test rows is found for each label by counting hashes in 2**16 bins, so that no label's
    rows have to be sorted in one task; only the rows of one bin for each label are then ranked.
    """
    checks.real("test_share", test_share, 0.0)
    strata = F.lit(0) if label is None else F.col(label)
    rows = df.withColumn("_s", strata).withColumn("_h", hash48(seed, F.col(key))).withColumn("_bin", F.shiftright("_h", 32))
    counts = rows.groupBy("_s", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_quota", F.floor(test_share * F.sum("_n").over(Window.partitionBy("_s"))))
    edge = edges.where((F.col("_upto") > F.col("_quota")) & (F.col("_upto") - F.col("_n") <= F.col("_quota"))).select(F.col("_s").alias("_s2"), F.col("_bin").alias("_edge"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_more"))
    near = rows.join(edge, rows["_s"].eqNullSafe(edge["_s2"]), "left").drop("_s2")
    at_edge = near.where(F.col("_bin") == F.col("_edge")).withColumn("is_test", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)) <= F.col("_more"))
    others = near.where(~F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))).withColumn("is_test", F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(False)))
    return others.unionByName(at_edge).drop("_s", "_h", "_bin", "_edge", "_more")
