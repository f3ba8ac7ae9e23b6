"""Measures of predictions. All are exact, and work on counted scores, so that ties and hot scores cost nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash48
from ..functions.storage import running_total


def _by_score(df: DataFrame, label: str, score: str, descending: bool = False) -> DataFrame:
    s = -F.col(score) if descending else F.col(score)
    good = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return good.groupBy(s.cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the share of pairs of a positive and a negative row that the score orders rightly; ties count half. Null if
    either kind is missing."""
    ranked = running_total(_by_score(df, label, score), [], ["s"], F.col("all") - F.col("pos"), "neg")
    below = F.col("neg") - (F.col("all") - F.col("pos"))
    won = F.sum(F.col("pos") * (below + 0.5 * (F.col("all") - F.col("pos"))))
    pairs = F.sum("pos") * F.sum(F.col("all") - F.col("pos"))
    return ranked.agg(F.when(pairs > 0, won / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: precision at each distinct score, weighted by the recall gained there."""
    first = running_total(_by_score(df, label, score, True), [], ["s"], F.col("pos"), "tp")
    both = running_total(first, [], ["s"], F.col("all"), "n")
    return both.agg(F.when(F.sum("pos") > 0, F.sum(F.col("tp") / F.col("n") * F.col("pos")) / F.sum("pos")).alias("average_precision"))


def _each_class(df: DataFrame, label: str, probabilities: str, n_classes: int) -> DataFrame:
    """(k, s, pos, all): for each class and score the rows of the class, and all rows."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(label) == k).cast("long").alias("y"), F.get(probabilities, k).alias("s")) for k in range(n_classes))))
    rows = df.where(F.col(label).isNotNull()).select(each.alias("x")).select("x.*").where(F.col("s").isNotNull())
    return rows.groupBy("k", F.col("s").cast("double").alias("s")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("all"))


def class_aucs(df: DataFrame, label: str, probabilities: str, n_classes: int) -> DataFrame:
    """(k, n, roc_auc, average_precision) for each class against the rest, all in one pass; null where a side is missing."""
    cells = _each_class(df, label, probabilities, n_classes)
    ranked = running_total(running_total(cells, ["k"], ["s"], F.col("pos"), "pos_upto"), ["k"], ["s"], F.col("all"), "all_upto")
    sums = cells.groupBy("k").agg(F.sum("pos").alias("n"), F.sum("all").alias("total"))
    rest = F.col("all") - F.col("pos")
    below = (F.col("all_upto") - F.col("pos_upto")) - rest
    tp, at = F.col("n") - F.col("pos_upto") + F.col("pos"), F.col("total") - F.col("all_upto") + F.col("all")
    got = ranked.join(F.broadcast(sums), "k").groupBy("k").agg(F.first("n").alias("n"), F.first("total").alias("total"), F.sum(F.col("pos") * (below + 0.5 * rest)).alias("won"), F.sum(tp / at * F.col("pos")).alias("ap"))
    pairs = F.col("n") * (F.col("total") - F.col("n"))
    return got.select("k", "n", F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"), F.when(F.col("n") > 0, F.col("ap") / F.col("n")).alias("average_precision"))


def averaged(scores: DataFrame, name: str) -> DataFrame:
    """One row of class_aucs(): the mean over classes, and that weighted by their rows."""
    known = F.col(name).isNotNull()
    return scores.agg(F.avg(name).alias("macro"), (F.sum(F.col(name) * F.col("n")) / F.sum(F.when(known, F.col("n")))).alias("weighted"))


def multiclass_auc(df: DataFrame, label: str, probabilities: str, n_classes: int, how: str = "ovr", average: str = "macro") -> float:
    """One class against the rest (macro or weighted by class size), or all pairs of classes (macro)."""
    if how == "ovr":
        return averaged(class_aucs(df, label, probabilities, n_classes), "roc_auc").first()[average]
    pairs = [F.when(F.col(label).isin(a, b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in combinations(range(n_classes), 2)]
    each = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p"), label, probabilities).select("p.*", label, probabilities)
    sides = F.explode(F.array(*(F.struct(F.col(c).alias("one"), (F.col(label) == F.col(c)).cast("long").alias("y"), F.get(F.col(probabilities), F.col(c)).cast("double").alias("s")) for c in ("a", "b"))))
    cells = each.select("a", "b", sides.alias("x")).select("a", "b", "x.*").groupBy("a", "b", "one", "s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("all"))
    keys = ["a", "b", "one"]
    rest = F.col("all") - F.col("pos")
    ranked = running_total(cells, keys, ["s"], rest, "neg")
    won = ranked.groupBy(*keys).agg((F.sum(F.col("pos") * (F.col("neg") - rest + 0.5 * rest)) / (F.sum("pos") * F.sum(rest))).alias("auc"))
    return won.agg(F.avg("auc")).first()[0]


def likelihood(label: str, probabilities: str) -> Column:
    """What the label's own class was given, kept off 0 and 1."""
    return F.greatest(F.least(F.get(probabilities, F.col(label)), F.lit(1 - 1e-15)), F.lit(1e-15))


def log_loss(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    return df.agg(F.avg(-F.log(likelihood(label, probabilities))).alias("log_loss"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: mse, mae and r2 (null for a constant label)."""
    d = F.col(label) - F.col(prediction)
    total = F.var_pop(label) * F.count(label)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.when(total > 0, 1 - F.sum(d * d) / total).alias("r2"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support) for each label that occurs on either side; shares of nothing are 0."""
    cells = confusion(df, label, prediction)
    side = F.explode(F.array(F.struct(F.col(label).alias("k"), F.lit(True).alias("true")), F.struct(F.col(prediction).alias("k"), F.lit(False).alias("true"))))
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    got = cells.select("n", hit.alias("hit"), side.alias("x")).groupBy(F.col("x.k").alias("label")).agg(F.sum(F.when(F.col("x.true"), F.col("hit"))).alias("tp"), F.sum(F.when(F.col("x.true"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.true"), F.col("n")).otherwise(0)).alias("named"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.coalesce("tp", F.lit(0))
    out = got.select("label", share(tp, F.col("named")).alias("precision"), share(tp, F.col("support")).alias("recall"), "support")
    p, r = F.col("precision"), F.col("recall")
    return out.select("label", "precision", "recall", share(2 * p * r, p + r).alias("f1"), "support")


def summary(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation of each value for each group of runs."""
    return runs.groupBy(*by).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def grid(spark: object, **axes: list) -> DataFrame:
    """Every combination of the given settings: a table of settings, not of data."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out


def over_seeds(run: Callable[[int], DataFrame], seeds: Sequence[int]) -> DataFrame:
    """(seed, ...): what run gives for each seed, one below the other; summary() then tells their mean and spread."""
    out = None
    for seed in seeds:
        one = run(seed).select(F.lit(seed).alias("seed"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def drawn_settings(spark: object, n: int, seed: int = 0, **axes: list) -> DataFrame:
    """(trial, settings...): n random choices of settings, each by a hash of the seed, the trial and the setting's name."""
    pick = lambda name, values: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(hash48(seed, F.col("trial"), name), F.lit(len(values))).cast("int"))
    return spark.range(n).select(F.col("id").alias("trial")).select("trial", *(pick(k, v).alias(k) for k, v in axes.items()))


def what_if(model: object, df: DataFrame, key: str, label_code: str, steps: list[float], dirichlets: list[float]) -> DataFrame:
    """(step, dirichlet, log_loss) of a classifier for each pair of settings, without growing a tree again.

    Rows alike in bins are taken to their leaves once; what differs between settings is worked out from nodes, and joined by
    leaf. Rows are then counted by bins and label.
    """
    leaves = model.leaves_for(steps, dirichlets)
    coded = model.encoder.transform(df).select("bins", label_code)
    at = model.of_bins(coded).join(F.broadcast(leaves), ["tree", "path"])
    mean = at.groupBy("bins", "step", "dirichlet").agg(*(F.avg(F.get("prediction", i)).alias(f"p{i}") for i in range(model.n_classes)))
    mean = mean.select("bins", "step", "dirichlet", F.array(*(f"p{i}" for i in range(model.n_classes))).alias("probabilities"))
    counts = coded.where(F.col(label_code).isNotNull()).groupBy("bins", label_code).agg(F.count(F.lit(1)).alias("n"))
    loss = -F.log(likelihood(label_code, "probabilities"))
    return mean.join(counts, "bins").groupBy("step", "dirichlet").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("log_loss"))
