"""Binning of features: quantile bins for numbers, codes for categories, one more bin for what is missing or unknown."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.hashing import hash48
from ..functions.storage import running_total, stored

HIGHEST = 1e300


def quantile_ranks(n: int, max_bins: int) -> list[tuple[int, int]]:
    """The two ranks (from 0) whose values make each of max_bins - 1 thresholds."""
    out = []
    for i in range(1, max_bins):
        h = (i * (100 / max_bins)) / 100 * (n - 1)
        out.append((int(h), min(n - 1, -int(-h // 1))))
    return out


def between(a: float, b: float) -> float:
    """The middle of two values of a rank."""
    return min(a if a == b else b - (b - a) * 0.5, HIGHEST)


def middle(a: float, b: float) -> float:
    """The middle of two neighbours."""
    half = (a + b) * 0.5
    return min(half if abs(half) != float("inf") else a * 0.5 + b * 0.5, HIGHEST)


def thresholds(df: DataFrame, names: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Of each numeric feature, the ascending thresholds of its bins: middles of neighbours if there are up to max_bins
    distinct values, else quantiles. All features are worked out together, from their counted values."""
    if not names:
        return {}
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), checks.value_of(df, c).alias("x")) for i, c in enumerate(names))))
    counts = stored(df.select(pairs.alias("p")).select("p.*").where(F.col("x").isNotNull()).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")), "values")
    sizes = {r.feature: (r.d, r.n) for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()}
    few = [f for f, (d, _) in sizes.items() if d <= max_bins]
    out: dict[str, list[float]] = {c: [] for c in names}
    if few:
        for r in counts.where(F.col("feature").isin(few)).groupBy("feature").agg(F.array_sort(F.collect_list("x")).alias("xs")).collect():
            out[names[r.feature]] = [middle(a, b) for a, b in zip(r.xs, r.xs[1:], strict=False)]
    many = [f for f in sizes if f not in few]
    if many:
        ranks = {f: quantile_ranks(sizes[f][1], max_bins) for f in many}
        wanted = counts.sparkSession.createDataFrame([(f, r) for f in many for r in sorted({x for p in ranks[f] for x in p})], "feature int, rank long")
        upto = running_total(counts.where(F.col("feature").isin(many)), ["feature"], ["x"], F.col("n"), "upto")
        spots = upto.join(F.broadcast(wanted), "feature").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        at = {(r.feature, r.rank): r.x for r in spots.select("feature", "rank", "x").collect()}
        for f in many:
            out[names[f]] = [between(at[f, a], at[f, b]) for a, b in ranks[f]]
    return out


def bin_of(value: Column, cuts: Sequence[float], df: DataFrame, to: str) -> tuple[DataFrame, Column]:
    """How many cuts lie under the value, by binary search in the JVM.

    Bucketizer's buckets hold their lower end, bins their upper one; so both are negated.
    """
    distinct = sorted(set(cuts))
    under = [0] + [sum(c <= d for c in cuts) for d in distinct]
    splits = [-float("inf"), *(-c for c in reversed(distinct)), float("inf")]
    got = Bucketizer(splits=splits, inputCol=f"{to}_in", outputCol=f"{to}_out", handleInvalid="keep").transform(df.withColumn(f"{to}_in", -value))
    lookup = F.array(*(F.lit(x) for x in reversed(under)))
    return got, F.get(lookup, F.col(f"{to}_out").cast("int"))


@dataclass
class EncoderModel:
    """What has been learned of each feature. A feature's bins are 0 to n_bins - 1, and n_bins if missing or unknown."""

    names: list[str]
    categorical: list[bool]
    numeric: list[bool]
    cuts: dict[str, list[float]]
    categories: dict[str, list]
    handle_unknown: str = "error"
    out_col: str = "bins"
    n_bins: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.n_bins = [len(self.categories[c]) if k else len(self.cuts[c]) + 1 for c, k in zip(self.names, self.categorical, strict=True)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds out_col, an array of bins. Stateless: df may be a stream, unless unknown categories are an error."""
        checks.features_of(df, self.names)
        keep = df.columns
        if self.handle_unknown == "error" and any(self.categorical):
            unknown = F.array(*(F.when(self.raw(df, c).isNotNull() & ~F.coalesce(self.raw(df, c).isin(self.categories[c]), F.lit(False)), F.struct(F.lit(i).alias("i"), self.raw(df, c).cast("string").alias("v"))) for i, c in enumerate(self.names) if self.categorical[i]))
            bad = df.select(F.explode(F.array_compact(unknown)).alias("u")).select("u.*").distinct().orderBy("i", "v").limit(20).collect()
            if bad:
                i = bad[0].i
                raise ValueError(f"Found unknown categories {{{', '.join(repr(r.v) for r in bad if r.i == i)}}} in column {i} during transform")
        out, cells = df, []
        for i, c in enumerate(self.names):
            value = self.raw(df, c)
            if self.categorical[i]:
                known = F.array(*(F.lit(x) for x in self.categories[c])) if self.categories[c] else None
                spot = F.nullif(F.array_position(known, value), F.lit(0)) - 1 if known is not None else F.lit(None)
            elif self.cuts[c]:
                out, spot = bin_of(value, self.cuts[c], out, f"_{i}")
            else:
                spot = F.lit(0)
            cells.append(F.coalesce(F.when(value.isNotNull(), spot), F.lit(self.n_bins[i])).cast("int"))
        return out.select(*(F.col(f"`{c}`") for c in keep), F.array(*cells).alias(self.out_col))

    def raw(self, df: DataFrame, name: str) -> Column:
        value = checks.value_of(df, name)
        i = self.names.index(name)
        return value if self.numeric[i] else value.cast("string")

    def inverse(self, df: DataFrame, bins_col: str = "bins") -> DataFrame:
        """Adds, for each feature, its category or its interval (left, right]; null where missing."""
        for i, c in enumerate(self.names):
            b = F.get(F.col(bins_col), i)
            if self.categorical[i]:
                df = df.withColumn(f"{c}_value", F.get(F.array(*(F.lit(x) for x in self.categories[c])), b) if self.categories[c] else F.lit(None))
            else:
                ends = F.array(F.lit(float("-inf")), *(F.lit(x) for x in self.cuts[c]), F.lit(float("inf")))
                df = df.withColumn(f"{c}_interval", F.when(b < self.n_bins[i], F.struct(F.get(ends, b).alias("left"), F.get(ends, b + 1).alias("right"))))
        return df

    def state(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("names", "categorical", "numeric", "cuts", "categories", "handle_unknown", "out_col")})

    @staticmethod
    def from_state(text: str) -> EncoderModel:
        return EncoderModel(**json.loads(text))


class Encoder:
    """Learns bins. max_bins: for numbers; subsample: how many rows their quantiles are taken from, None for all."""

    def __init__(self, *, max_bins: int = 256, is_categorical: Sequence[object] | None = None, subsample: int | None = 200_000, cat_min_categories: int | str = "log", handle_unknown: str = "error", seed: int = 0, out_col: str = "bins") -> None:
        self.max_bins = checks.whole("max_bins", max_bins, 3)
        self.is_categorical = is_categorical
        self.subsample = None if subsample is None else checks.whole("subsample", subsample, 50_000)
        if cat_min_categories not in ("log", "sqrt"):
            checks.whole("cat_min_categories", cat_min_categories, 4)
        self.cat_min_categories = cat_min_categories
        self.handle_unknown = str(checks.choice("handle_unknown", handle_unknown, ("error", "consider_missing")))
        self.seed, self.out_col = seed, out_col

    def fit(self, df: DataFrame, names: Sequence[str] | None = None) -> EncoderModel:
        """df may hold nulls and NaN in any column; an empty table gives one bin to each number and none to a category."""
        names = checks.features_of(df, names)
        numeric = [isinstance(df.schema[c].dataType, checks.NUMBERS) for c in names]
        categorical = checks.roles(df, names, checks.categorical_mask(self.is_categorical, names), self.cat_min_categories)
        rows = df.select(*(F.col(f"`{c}`") for c in names))
        few = rows
        if self.subsample is not None and rows.count() > self.subsample:
            # Equal rows are told apart by their number, so that each goes in or stays out by itself.
            copies = rows.groupBy(*(F.col(f"`{c}`") for c in rows.columns)).agg(F.count(F.lit(1)).alias("_copies"))
            each = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            own = [F.col(f"`{c}`") for c in rows.columns]
            few = each.orderBy(hash48(self.seed, F.to_json(F.struct(*own)), F.col("_copy")), *own, "_copy").limit(self.subsample).select(*own)
        cuts = thresholds(few, [c for c, k in zip(names, categorical, strict=True) if not k], self.max_bins)
        named = [c for c, k in zip(names, categorical, strict=True) if k]
        values = rows.agg(*(F.array_sort(F.collect_set(checks.value_of(rows, c))).alias(f"c{i}") for i, c in enumerate(named))).first() if named else []
        return EncoderModel(names, categorical, numeric, cuts, {c: list(values[i]) for i, c in enumerate(named)}, self.handle_unknown, self.out_col)


def fit_transform(encoder: Encoder, df: DataFrame, names: Sequence[str] | None = None) -> tuple[EncoderModel, DataFrame]:
    """The model, and df with its bins."""
    model = encoder.fit(df, names)
    return model, model.transform(df)


def load_state(spark: SparkSession, path: str) -> EncoderModel:
    return EncoderModel.from_state(spark.read.text(path).first()[0])
