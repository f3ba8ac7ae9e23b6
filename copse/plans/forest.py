"""Forests of histogram trees that predict with an average over all prunings of each tree."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.storage import numbered, sent_if_small, stored
from ..operators import metrics, sampling
from ..operators.aggregation import leaf_predictions, log_weights
from ..operators.encoder import Encoder, EncoderModel
from ..operators.growth import Rules, grow, with_losses
from ..operators.histograms import NODE, goes_left

#: A path is followed for so many levels before it is written and read again.
LEVELS = 8


@dataclass(frozen=True)
class Params:
    """n_estimators: trees. criterion: gini, entropy or mse. step: rate of the exponential weights. aggregation: whether all
    prunings are averaged. dirichlet: smoothing of class shares. max_depth: None for no limit. multiclass: multinomial or
    ovr (a forest for each class). cat_split_strategy: binary, all or random. class_weight: None or balanced."""

    n_estimators: int = 10
    criterion: str = "gini"
    step: float = 1.0
    aggregation: bool = True
    dirichlet: float = 0.5
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_bins: int = 256
    categorical_features: Sequence[object] | None = None
    max_features: object = "auto"
    handle_unknown: str = "consider_missing"
    cat_min_categories: int | str = "log"
    subsample: int | None = 200_000
    random_state: int = 0
    class_weight: str | None = None
    multiclass: str = "multinomial"
    cat_split_strategy: str = "binary"
    randomized_depth: bool = False

    def __post_init__(self) -> None:
        checks.whole("n_estimators", self.n_estimators, 1)
        checks.choice("criterion", self.criterion, ("gini", "entropy", "mse"))
        checks.real("step", self.step, 0.0, strict=True)
        checks.real("dirichlet", self.dirichlet, 0.0, strict=self.aggregation and self.criterion != "mse")
        if self.max_depth is not None:
            checks.whole("max_depth", self.max_depth, 2)
        checks.whole("min_samples_split", self.min_samples_split, 2)
        checks.whole("min_samples_leaf", self.min_samples_leaf, 1)
        checks.whole("max_bins", self.max_bins, 3)
        checks.whole("random_state", self.random_state, 0)
        checks.choice("handle_unknown", self.handle_unknown, ("error", "consider_missing"))
        checks.choice("class_weight", self.class_weight, (None, "balanced"))
        checks.choice("multiclass", self.multiclass, ("multinomial", "ovr"))
        checks.choice("cat_split_strategy", self.cat_split_strategy, ("binary", "all", "random", "mean"))


class _Forest:
    default = "gini"

    def __init__(self, **params: object) -> None:
        self.params = Params(**{"criterion": self.default, **params})

    def fit(self, df: DataFrame, label: str, *, key: str, features: Sequence[str] | None = None, weight: str | None = None, categorical_features: Sequence[object] | None = None) -> ForestModel:
        """key: a unique column, from whose order rows are numbered, so that a rerun draws the same bags. Rows with a null
        label or weight are left out."""
        p = self.params
        names = checks.features_of(df, features if features is not None else [c for c in df.columns if c not in (label, key, weight)])
        good = df.where(F.col(label).isNotNull() & (F.col(weight).isNotNull() if weight else F.lit(True)))
        if p.criterion != "mse":
            classes = sampling.classes_of(good, label)
            if not classes:
                raise ValueError("There are no labelled rows")
            good = good.withColumn("_y", sampling.label_code(label, classes))
        else:
            classes = []
            good = good.withColumn("_y", F.col(label).cast("double")).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
        good = good.withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
        if p.class_weight == "balanced" and classes:
            good = good.join(F.broadcast(sampling.balanced_weights(good, "_y")), "_y").withColumn("_w", F.col("_w") * F.col("class_weight"))
        encoder = Encoder(max_bins=p.max_bins, is_categorical=categorical_features if categorical_features is not None else p.categorical_features, subsample=p.subsample, cat_min_categories=p.cat_min_categories, handle_unknown=p.handle_unknown, seed=p.random_state).fit(good, names)
        coded = encoder.transform(good.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*names, key])), "_y", "_w"))
        coded = coded.select(key, F.col("_y").alias("y"), F.col("_w").alias("w"), "bins")
        n, dense = dense_key(good, key)
        if not n:
            raise ValueError("There are no labelled rows")
        ovr = p.multiclass == "ovr" and len(classes) > 2
        rows = coded.withColumn("row_id", F.col(key).cast("long")) if dense else numbered(coded, [key])
        bag = self.bag(rows.select("row_id", "y", "w", "bins"), n)
        if ovr:  # tree numbers count the classes' trees one after another; trees of one number share their bag
            k = F.explode(F.sequence(F.lit(0), F.lit(len(classes) - 1)))
            bag = bag.withColumn("k", k).withColumn("y", (F.col("y") == F.col("k")).cast("int")).withColumn("tree", F.col("k") * p.n_estimators + F.col("tree")).drop("k")
        assign = bag.withColumn("path", F.lit(""))
        n_classes = 0 if p.criterion == "mse" else 2 if ovr else max(2, len(classes))
        rules = Rules(p.criterion, n_classes, encoder.categorical, sampling.max_features(p.max_features, len(names)), p.max_depth, p.min_samples_split, p.min_samples_leaf, p.aggregation, p.cat_split_strategy, p.randomized_depth, p.dirichlet, p.random_state)
        nodes = grow(stored(assign, "assigned"), rules)
        return ForestModel(p, encoder, classes, nodes, n, n_classes)

    def bag(self, rows: DataFrame, n: int) -> DataFrame:
        """The rows of each tree, in its bag (is_train) and out of it, summed up over rows alike in bins and class: of those
        there are no more than the bins can make, however many rows there are.

        Rows are dealt by bins, so that most sums are made within a task; a task that gets too many is split.
        """
        p = self.params
        drawn, counts = sampling.drawn_by_row(rows.sparkSession, n, p.n_estimators, p.random_state)
        alike = ["bins"] if p.criterion == "mse" else ["bins", "y"]
        met = rows.join(drawn, "row_id", "left").select("bins", "y", "w", counts.alias("drawn")).hint("rebalance", *(F.col(c) for c in alike))
        each = met.select("bins", "y", "w", F.posexplode("drawn").alias("tree", "n_drawn")).withColumn("is_train", F.col("n_drawn") > 0)
        each = each.withColumn("w", F.col("w") * F.greatest("n_drawn", F.lit(1)))
        more = [F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy")] if p.criterion == "mse" else []
        return each.groupBy("tree", "is_train", *alike).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *more)


def dense_key(df: DataFrame, key: str) -> tuple[int, bool]:
    """How many rows there are, and whether their keys are the numbers from 0 on, each once, so that rows are numbered already."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    if not whole:
        return df.count(), False
    told = lambda c: (F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.sum(c.cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(c)).alias("hash"))
    got = df.agg(F.count(F.lit(1)).alias("rows"), *told(F.col(f"`{key}`").cast("long"))).first()
    n = got["rows"]
    return n, n > 0 and got[1:] == df.sparkSession.range(n).agg(*told(F.col("id"))).first()[:]


class ForestClassifier(_Forest):
    """fit(df, label, key=...) gives a model; see Params for the settings."""

    def __init__(self, **params: object) -> None:
        super().__init__(**params)
        if self.params.criterion == "mse":
            raise ValueError("criterion should be gini or entropy")


class ForestRegressor(_Forest):
    default = "mse"

    def __init__(self, **params: object) -> None:
        super().__init__(**params)
        if self.params.criterion != "mse":
            raise ValueError("criterion should be mse")


class ForestModel:
    """A fitted forest: a table of nodes and an encoder. Settings that need no rows can still be changed: with_settings()."""

    def __init__(self, params: Params, encoder: EncoderModel, classes: list, nodes: DataFrame, n_rows: int, n_classes: int) -> None:
        self.params, self.encoder, self.classes, self.n_rows, self.n_classes = params, encoder, classes, n_rows, n_classes
        self.raw = nodes.drop("log_weight_tree")
        self.nodes = stored(log_weights(self.raw, params.step), "model")
        self.leaves = stored(leaf_predictions(self.nodes, params.step, params.aggregation), "leaves")
        self.depth = self.nodes.agg(F.max("depth")).first()[0] or 0

    @property
    def n_features(self) -> int:
        return len(self.encoder.names)

    @property
    def ovr(self) -> bool:
        return self.params.multiclass == "ovr" and len(self.classes) > 2

    def with_settings(self, *, step: float | None = None, dirichlet: float | None = None, aggregation: bool | None = None) -> ForestModel:
        """The same trees with other weights or another smoothing, from the nodes alone."""
        given = {k: v for k, v in (("step", step), ("dirichlet", dirichlet), ("aggregation", aggregation)) if v is not None}
        p = replace(self.params, **given)
        nodes = with_losses(self.raw.drop("y_pred", "loss_valid"), p.criterion, self.n_classes, p.dirichlet)
        return ForestModel(p, self.encoder, self.classes, nodes, self.n_rows, self.n_classes)

    def leaves_for(self, steps: Sequence[float], dirichlets: Sequence[float]) -> DataFrame:
        """(step, dirichlet, tree, path, prediction, ...): what the leaves predict under each pair of settings."""
        spark = self.raw.sparkSession
        pairs = spark.createDataFrame([(float(s), float(a)) for a in dirichlets for s in steps], "step double, dirichlet double")
        nodes = self.raw.drop("y_pred", "loss_valid").crossJoin(F.broadcast(pairs))
        nodes = stored(with_losses(nodes, self.params.criterion, self.n_classes, F.col("dirichlet")), "settings")
        keys = ("tree", "step", "dirichlet")
        return leaf_predictions(log_weights(nodes, F.col("step"), keys), F.col("step"), self.params.aggregation, keys)

    def coded(self, df: DataFrame, key: str) -> DataFrame:
        return self.encoder.transform(df).select(F.col(key), "bins")

    def of_bins(self, coded: DataFrame) -> DataFrame:
        """A row (bins, tree, path) for each tree and all distinct bins, at their leaf: rows alike in bins go one way."""
        trees = self.nodes.select("tree").distinct()
        at = coded.select("bins").distinct().crossJoin(F.broadcast(trees)).withColumn("path", F.lit(""))
        splits = self.nodes.where(~F.col("is_leaf")).select(*NODE, "depth", "feature", "bin_threshold", "is_split_categorical", "bin_partition")
        sizes = {r.depth: r["count"] for r in splits.groupBy("depth").count().collect()}
        for d in range(self.depth):
            level = splits.where(F.col("depth") == d).drop("depth")
            step = F.when(F.col("feature").isNull(), F.lit("")).when(goes_left(F.get("bins", F.col("feature"))), F.lit("1")).otherwise(F.lit("0"))
            at = at.join(sent_if_small(level, sizes.get(d, 0)), NODE, "left").select("bins", "tree", F.concat("path", step).alias("path"))
            if d % LEVELS == LEVELS - 1 and d + 1 < self.depth:
                at = stored(at, "routed")
        return at

    def leaves_of_bins(self, coded: DataFrame) -> DataFrame:
        return self.of_bins(coded).join(sent_if_small(self.leaves, self.leaves.count()), NODE)

    def told(self, coded: DataFrame, found: DataFrame) -> DataFrame:
        """The rows with what was found of their bins, of which found has a row each."""
        found = stored(found, "found")
        return coded.join(sent_if_small(found, found.count()), "bins")

    def told_each(self, coded: DataFrame, found: DataFrame) -> DataFrame:
        """The same where found has several rows of the same bins."""
        one = found.groupBy("bins").agg(F.collect_list(F.struct(*(c for c in found.columns if c != "bins"))).alias("_each"))
        got = self.told(coded, one)
        kept = [c for c in got.columns if c != "_each"]
        return got.select(*kept, F.explode("_each").alias("_one")).select(*kept, "_one.*")

    def apply(self, df: DataFrame, key: str, *, bins: bool = False) -> DataFrame:
        """A row (key, tree, path) for each row and tree, at its leaf."""
        coded = self.coded(df, key)
        at = self.told_each(coded, self.of_bins(coded)).select(key, "bins", "tree", "path")
        return at if bins else at.drop("bins")

    def leaf_ids(self, df: DataFrame, key: str) -> DataFrame:
        """(key, tree, leaf_id)."""
        coded = self.coded(df, key)
        return self.told_each(coded, self.leaves_of_bins(coded).select("bins", "tree", "leaf_id")).select(key, "tree", "leaf_id")

    def at_leaves(self, df: DataFrame, key: str) -> DataFrame:
        coded = self.coded(df, key)
        return self.told_each(coded, self.leaves_of_bins(coded)).drop("bins")

    def predict_trees(self, df: DataFrame, key: str) -> DataFrame:
        """(key, tree, prediction) for each row and tree."""
        coded = self.coded(df, key)
        return self.told_each(coded, self.leaves_of_bins(coded).select("bins", "tree", "prediction")).select(key, "tree", "prediction")

    def predict_proba(self, df: DataFrame, key: str) -> DataFrame:
        """(key, probabilities): the mean over trees; with a forest for each class, the classes' own shares, scaled to sum 1,
        or even ones if all are 0."""
        coded = self.coded(df, key)
        each = self.leaves_of_bins(coded)
        k = len(self.classes)
        if not self.ovr:
            mean = each.groupBy("bins").agg(*(F.avg(F.get("prediction", i)).alias(f"p{i}") for i in range(self.n_classes)))
            return self.told(coded, mean).select(key, F.array(*(F.col(f"p{i}") for i in range(max(k, 1)))).alias("probabilities"))
        of = F.floor(F.col("tree") / self.params.n_estimators)
        sums = each.groupBy("bins").agg(*(F.sum(F.when(of == i, F.get("prediction", 1)).otherwise(0.0)).alias(f"p{i}") for i in range(k)))
        total = sum((F.col(f"p{i}") for i in range(k)), F.lit(0.0))
        return self.told(coded, sums).select(key, F.array(*(F.when(total > 1.2e-7, F.col(f"p{i}") / total).otherwise(1.0 / k) for i in range(k))).alias("probabilities"))

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, prediction): the label of highest probability, the first of ties; or the mean over trees."""
        if self.params.criterion == "mse":
            return self.means(df, key).select(key, "prediction")
        labels = F.array(*(F.lit(c) for c in self.classes))
        p = F.col("probabilities")
        return self.predict_proba(df, key).select(key, F.get(labels, (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias("prediction"), "probabilities")

    def score(self, df: DataFrame, label: str, key: str) -> float:
        """The share of rows whose label is predicted, or R2 of a regression."""
        got = self.predict(df, key).select(key, F.col("prediction").alias("_said")).join(df.select(key, F.col(label).alias("_true")), key)
        if self.params.criterion == "mse":
            return metrics.errors(got.withColumn("_true", F.col("_true").cast("double")), "_true", "_said").first()["r2"]
        return metrics.accuracy(got, "_true", "_said").first()[0]

    def weighted_depth(self, df: DataFrame, key: str) -> DataFrame:
        """(key, weighted_depth): the depth averaged as predictions are, and over trees."""
        return self.means(df, key).select(key, "weighted_depth")

    def means(self, df: DataFrame, key: str) -> DataFrame:
        """(key, prediction, weighted_depth): the means over trees of a prediction's first number and of the weighted depth."""
        coded = self.coded(df, key)
        found = self.leaves_of_bins(coded).groupBy("bins").agg(F.avg(F.get("prediction", 0)).alias("prediction"), F.avg("weighted_depth").alias("weighted_depth"))
        return self.told(coded, found).select(key, "prediction", "weighted_depth")

    def path_of(self, df: DataFrame, key: str) -> DataFrame:
        """(key, tree, depth, node_id, decision): how each row comes to its leaf."""
        coded = self.coded(df, key)
        at = self.of_bins(coded).withColumn("leaf", F.col("path"))
        steps = at.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.length("leaf")), lambda d: F.substring(F.col("leaf"), F.lit(1), d))))
        names = F.array(*(F.lit(c) for c in self.encoder.names))
        left = F.substring(F.col("leaf"), F.length("path") + 1, F.lit(1)) == "1"
        numeric = F.format_string("%s %s %s", F.get(names, F.col("feature")), F.when(left, "<=").otherwise(">"), self.threshold())
        named = F.format_string("%s %s {%s}", F.get(names, F.col("feature")), F.when(left, "in").otherwise("not in"), F.concat_ws(", ", F.col("bin_partition").cast("array<string>")))
        text = F.when(F.col("is_leaf"), "leaf").when(F.col("is_split_categorical"), named).otherwise(numeric)
        found = steps.join(sent_if_small(self.nodes, self.nodes.count()), NODE).select("bins", "tree", "depth", "node_id", text.alias("decision"))
        return self.told_each(coded, found).select(key, "tree", "depth", "node_id", "decision")

    def threshold(self) -> Column:
        """The value that a numeric split compares with."""
        cuts = F.array(*(F.array(*(F.lit(float(x)) for x in self.encoder.cuts.get(c, []))).cast("array<double>") for c in self.encoder.names))
        return F.get(F.get(cuts, F.col("feature")), F.col("bin_threshold"))

    def tree_sizes(self) -> DataFrame:
        """(tree, n_nodes, n_leaves, depth)."""
        return self.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("is_leaf")).alias("n_leaves"), F.max("depth").alias("depth"))

    def layout(self) -> DataFrame:
        """(tree, node_id, x, y) for drawing: a left child stands 0.5 ** (depth + 1) left of its parent."""
        sides = F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.when(F.substring(F.col("path"), i, F.lit(1)) == "1", -1.0).otherwise(1.0) * F.pow(F.lit(0.5), i))
        x = F.when(F.length("path") > 0, F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)
        top = self.nodes.groupBy("tree").agg(F.max("depth").alias("top"))
        return self.nodes.join(top, "tree").select("tree", "node_id", x.alias("x"), (F.col("top") - F.col("depth")).alias("y"))

    def size_bytes(self) -> int:
        """Characters of the nodes and settings as JSON: how large the model is, whatever format it is kept in."""
        nodes = self.raw.agg(F.sum(F.length(F.to_json(F.struct(*self.raw.columns))))).first()[0] or 0
        return nodes + len(self.encoder.state())

    def save(self, path: str) -> None:
        """Parquet of the nodes, and the settings as text."""
        spark = self.nodes.sparkSession
        self.raw.write.parquet(f"{path}/nodes")
        kinds = {"params": self.params.__dict__ | {"categorical_features": list(self.params.categorical_features or [])}, "classes": self.classes, "n_rows": self.n_rows, "n_classes": self.n_classes, "encoder": self.encoder.state()}
        spark.createDataFrame([(json.dumps(kinds),)], "value string").coalesce(1).write.text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        got = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return ForestModel(Params(**got["params"]), EncoderModel.from_state(got["encoder"]), got["classes"], spark.read.parquet(f"{path}/nodes"), got["n_rows"], got["n_classes"])
