"""Transforms of a table before a model: scaling, one-hot and ordinal codes, label statistics, filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks


def features_and_label(df: DataFrame, label: str, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    return df.drop(label, *drop), df.select(label)


def column_roles(df: DataFrame, label: str, drop: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Continuous and categorical columns by their types."""
    names = [c for c in df.columns if c != label and c not in drop]
    continuous = [c for c in names if isinstance(df.schema[c].dataType, checks.NUMBERS)]
    return continuous, [c for c in names if c not in continuous]


@dataclass
class Pipeline:
    """Fitted transforms: continuous columns first, categorical ones last. Unknown categories are all zeros in one-hot codes
    and -1 in ordinal ones; a constant column is centred only."""

    continuous: list[str]
    categorical: list[str]
    standardize: bool = True
    encoding: str = "one_hot"
    drop_first: bool = False
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Pipeline:
        checks.choice("encoding", self.encoding, ("one_hot", "ordinal", None))
        if self.standardize and self.continuous:
            value = {c: checks.value_of(df, c) for c in self.continuous}
            got = df.agg(*(f(value[c]).alias(f"{k}{i}") for i, c in enumerate(self.continuous) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
            self.means = {c: got[f"m{i}"] for i, c in enumerate(self.continuous)}
            self.deviations = {c: got[f"s{i}"] or 1.0 for i, c in enumerate(self.continuous)}
        if self.categorical:
            got = df.agg(*(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(self.categorical))).first()
            self.categories = {c: list(got[f"c{i}"]) for i, c in enumerate(self.categorical)}
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = [F.col(f"`{c}`") for c in keep]
        for c in self.continuous:
            x = F.col(f"`{c}`").cast("double")
            out.append(((x - self.means[c]) / self.deviations[c] if self.standardize else x).alias(c))
        for c in self.categorical:
            text, known = F.col(f"`{c}`").cast("string"), self.categories[c]
            if self.encoding == "one_hot":
                out += [F.coalesce((text == k).cast("int"), F.lit(0)).alias(f"{c}#{i}") for i, k in enumerate(known) if i or not self.drop_first]
            elif self.encoding == "ordinal":
                out.append(F.coalesce((F.array_position(F.array(*(F.lit(k) for k in known)), text) - 1).cast("int"), F.lit(-1)).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """A row (label, n, share) for each label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(df.agg(F.count(F.lit(1)).alias("total"))).select(label, "n", (F.col("n") / F.col("total")).alias("share"))


def gini_of_labels(df: DataFrame, label: str) -> DataFrame:
    """One row: n_rows, n_classes, gini (1 - sum p^2) and scaled_gini (by that of even classes)."""
    got = label_shares(df, label).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), (1 - F.sum(F.col("share") * F.col("share"))).alias("gini"))
    return got.withColumn("scaled_gini", F.when(F.col("n_classes") > 1, F.col("gini") / (1 - 1 / F.col("n_classes"))).otherwise(F.lit(0.0)))


def describe(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A row for each named table: its rows, feature columns, classes and scaled gini."""
    rows = None
    for name, (df, label) in tables.items():
        continuous, categorical = column_roles(df, label)
        one = gini_of_labels(df, label).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns) - 1).alias("n_features"), F.lit(len(continuous)).alias("n_continuous"), F.lit(len(categorical)).alias("n_categorical"), "n_classes", "scaled_gini")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("At least one table is needed")
    return rows


def without_rare_classes(df: DataFrame, label: str, least: int = 20) -> DataFrame:
    """The rows of labels that have at least so many rows; null labels go."""
    enough = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(F.broadcast(enough) if enough.limit(10_001).count() <= 10_000 else enough, label, "left_semi").select(*df.columns)


def missing_as_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(checks.value_of(df, c), F.lit(0.0)) for c in columns})


def first_share(df: DataFrame, order: str, share: float) -> DataFrame:
    """The first floor(share * rows) rows in the order of a key."""
    return df.orderBy(order).limit(int(checks.real("share", share, 0.0) * df.count()))
