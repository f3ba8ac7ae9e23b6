"""Queries for __spark_entry__.py: each operator on the test tables, with the same in SQL for DuckDB where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks, impurity, signals
from .functions.hashing import SQL_HASH48
from .functions.storage import numbered
from .operators import aggregation, bits, dataset, histograms, metrics, sampling
from .operators.encoder import Encoder, EncoderModel, thresholds
from .plans.forest import ForestClassifier, ForestModel, ForestRegressor
from .plans.forest_sql import Case, forest, mean_prediction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a unique key, and holes: l_tax is missing where the order key divides by 17."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_tax")).alias("l_tax"), "l_linestatus", "l_returnflag")


LINES = "lines AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity, l_extendedprice, l_discount, CASE WHEN l_orderkey % 17 <> 0 THEN l_tax END AS l_tax, l_linestatus, l_returnflag FROM lineitem)"
HASH = SQL_HASH48.format


@query("SELECT column_name, n_distinct, n_distinct <= 10 AS is_categorical FROM (SELECT 'l_quantity' AS column_name, count(DISTINCT l_quantity) AS n_distinct FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem)")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    df = table(spark, sf_dir, "lineitem")
    flags = checks.roles(df, names, None, 10)
    counts = df.agg(*(F.count_distinct(c).alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct"), F.lit(k).alias("is_categorical")) for c, k in zip(names, flags, strict=True)))).alias("x")).select("x.*")


@query("WITH x AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem), i AS (SELECT unnest(generate_series(1, 63)) AS i), h AS (SELECT DISTINCT i, (i * (100 / 64.0::DOUBLE)) / 100 * (n - 1) AS h FROM i, x) SELECT CAST(i AS INTEGER) AS position, round(CASE WHEN a.v = b.v THEN a.v ELSE b.v - (b.v - a.v) * 0.5 END, 6) AS threshold FROM h JOIN x a ON a.r = CAST(floor(h) AS BIGINT) JOIN x b ON b.r = CAST(ceil(h) AS BIGINT)")
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = thresholds(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], 64)["l_extendedprice"]
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "position int, threshold double").withColumn("threshold", r6("threshold"))


@query("WITH x AS (SELECT DISTINCT l_quantity AS v FROM lineitem), y AS (SELECT v, lead(v) OVER (ORDER BY v) AS w, row_number() OVER (ORDER BY v) AS i FROM x) SELECT CAST(i AS INTEGER) AS position, round((v + w) * 0.5, 6) AS threshold FROM y WHERE w IS NOT NULL")
def midpoint_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = thresholds(table(spark, sf_dir, "lineitem"), ["l_quantity"], 256)["l_quantity"]
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "position int, threshold double").withColumn("threshold", r6("threshold"))


def small_encoder(spark: SparkSession, sf_dir: str) -> EncoderModel:
    return Encoder(max_bins=256, is_categorical=["l_tax", "l_linestatus"], subsample=None, handle_unknown="consider_missing").fit(lines(spark, sf_dir), ["l_quantity", "l_tax", "l_linestatus"])


SMALL_BINS = f"WITH {LINES}, b AS (SELECT k, l_returnflag, l_extendedprice, (SELECT count(*) FROM (SELECT DISTINCT l_quantity AS v FROM lineitem) WHERE v < l_quantity) AS b0, CASE WHEN l_tax IS NULL THEN (SELECT count(DISTINCT l_tax) FROM lines) ELSE (SELECT count(*) FROM (SELECT DISTINCT l_tax AS v FROM lines) WHERE v < l_tax) END AS b1, (SELECT count(*) FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem) WHERE v < l_linestatus) AS b2 FROM lines)"


@query(f"{SMALL_BINS} SELECT k, CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, CAST(b2 AS INTEGER) AS b2 FROM b")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = small_encoder(spark, sf_dir).transform(lines(spark, sf_dir))
    return got.select("k", *(F.get("bins", i).alias(f"b{i}") for i in range(3)))


@query(f"WITH {LINES} SELECT k, CASE WHEN l_tax IS NULL OR round(l_tax * 100) = 3 THEN 8 ELSE (SELECT count(*) FROM (SELECT DISTINCT l_tax AS v FROM lines WHERE round(l_tax * 100) <> 3) WHERE v < l_tax) END AS code FROM lines")
def unknown_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    model = Encoder(is_categorical=[True], handle_unknown="consider_missing").fit(df.where(F.round(F.col("l_tax") * 100) != 3), ["l_tax"])
    return model.transform(df).select("k", F.get("bins", 0).cast("long").alias("code"))


@query(f"WITH {LINES}, v AS (SELECT DISTINCT l_quantity AS v FROM lineitem), e AS (SELECT v, lag(v) OVER (ORDER BY v) AS p, lead(v) OVER (ORDER BY v) AS n FROM v) SELECT k, l_tax AS tax, coalesce((p + v) * 0.5, CAST('-inf' AS DOUBLE)) AS low, coalesce((v + n) * 0.5, CAST('inf' AS DOUBLE)) AS high FROM lines JOIN e ON v = l_quantity")
def inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = small_encoder(spark, sf_dir)
    got = model.inverse(model.transform(lines(spark, sf_dir)))
    return got.select("k", F.col("l_tax_value").alias("tax"), F.col("l_quantity_interval.left").alias("low"), F.col("l_quantity_interval.right").alias("high"))


@query("SELECT word_id, word FROM (SELECT i // 21 AS word_id, CAST(sum(code * pow(2, 3 * (i % 21))) AS HUGEINT) AS word FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, l_linenumber - 1 AS code FROM lineitem) GROUP BY 1)".replace("CAST(sum(code * pow(2, 3 * (i % 21))) AS HUGEINT)", "CAST(sum(CAST(code AS HUGEINT) << (3 * (i % 21))::INT) AS BIGINT)"))
def pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "i")
    return bits.pack(df.withColumn("code", F.col("l_linenumber") - 1), "i", "code", 6)


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS index, CAST(l_linenumber - 1 AS INTEGER) AS code FROM lineitem")
def unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits.unpack(pack_bits(spark, sf_dir), 6, table(spark, sf_dir, "lineitem").count())


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return dataset.Pipeline(["c_acctbal"], []).fit(df).transform(df, ["c_custkey"]).withColumn("c_acctbal", r6("c_acctbal"))


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = (SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 1 OFFSET {i}) AS INTEGER) AS \"c_mktsegment#{i}\"" for i in range(5)) + " FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return dataset.Pipeline([], ["c_mktsegment"]).fit(df).transform(df, ["c_custkey"])


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE (SELECT count(DISTINCT d.c_mktsegment) FROM customer d WHERE d.c_mktsegment < c.c_mktsegment) END AS INTEGER) AS c_mktsegment FROM customer c")
def ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    model = dataset.Pipeline([], ["c_mktsegment"], encoding="ordinal").fit(df)
    return model.transform(df.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("c_mktsegment"))), ["c_custkey"])


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", sampling.label_code("o_orderpriority", sampling.classes_of(df, "o_orderpriority")).alias("code"))


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASH('concat_ws(chr(124), 0, o_orderkey)')}, o_orderkey) <= floor(0.3 * count(*) OVER (PARTITION BY o_orderpriority)) AS is_test FROM orders")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "is_test")


@query("WITH p AS (SELECT count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p FROM orders GROUP BY o_orderpriority) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, round(1 - sum(p * p), 6) AS gini, round((1 - sum(p * p)) / (1 - 1.0 / count(*)), 6) AS scaled_gini FROM p")
def label_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dataset.gini_of_labels(table(spark, sf_dir, "orders"), "o_orderpriority")
    return got.select("n_rows", "n_classes", r6("gini").alias("gini"), r6("scaled_gini").alias("scaled_gini"))


def _described(name: str, label: str, n: int, continuous: int) -> str:
    return f"SELECT '{name}' AS dataset, (SELECT count(*) FROM {name}) AS n_rows, {n} AS n_features, {continuous} AS n_continuous, {n - continuous} AS n_categorical, count(*) AS n_classes, round((1 - sum(p * p)) / (1 - 1.0 / count(*)), 6) AS scaled_gini FROM (SELECT count(*) / (SELECT count(*) FROM {name})::DOUBLE AS p FROM {name} GROUP BY {label})"


@query(" UNION ALL ".join([_described("customer", "c_mktsegment", 4, 3), _described("part", "p_type", 5, 3)]))
def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dataset.describe({n: (table(spark, sf_dir, n), k) for n, k in (("customer", "c_mktsegment"), ("part", "p_type"))})
    return got.withColumn("scaled_gini", r6("scaled_gini"))


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 80)")
def without_rare_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.without_rare_classes(table(spark, sf_dir, "part"), "p_brand", 80).select("p_partkey")


@query(f"WITH {LINES} SELECT k, coalesce(l_tax, 0) AS l_tax FROM lines")
def missing_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.missing_as_zero(lines(spark, sf_dir), ["l_tax"]).select("k", "l_tax")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM orders)")
def first_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_share(table(spark, sf_dir, "orders"), "o_orderkey", 0.2).select("o_orderkey")


@query("SELECT o_orderpriority, round(count(*) OVER (), 6) * 0 + round((SELECT count(*) FROM orders) / (5.0 * n), 6) AS class_weight FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)".replace("round(count(*) OVER (), 6) * 0 + ", ""))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_weights(table(spark, sf_dir, "orders"), "o_orderpriority").withColumn("class_weight", r6("class_weight"))


@query("WITH c AS (SELECT DISTINCT o_orderpriority AS p, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS k FROM orders) SELECT o_orderkey, CAST(k AS INTEGER) AS k, CAST(o_orderpriority = p AS INTEGER) AS y FROM orders, c")
def one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.one_vs_rest(label_codes(spark, sf_dir), "code", 5).select("o_orderkey", "k", "y")


BAG = f"bag AS (SELECT tree, {HASH('concat_ws(chr(124), 7, tree, draw)')} % (SELECT count(*) FROM customer) AS row_id, count(*) AS n_drawn FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM customer) - 1)) AS draw) d, (SELECT unnest(generate_series(0, 2)) AS tree) t GROUP BY 1, 2)"


def numbered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "customer"), ["c_custkey"])


@query(f"WITH {BAG} SELECT CAST(tree AS INTEGER) AS tree, row_id, CAST(n_drawn AS INTEGER) AS n_drawn FROM bag")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered_customers(spark, sf_dir)
    return sampling.bootstrap(df, df.count(), 3, 7)


@query(f"WITH {BAG}, r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer) SELECT CAST(t.tree AS INTEGER) AS tree, count(*) FILTER (n_drawn > 0) AS in_bag, count(*) FILTER (n_drawn IS NULL) AS out_of_bag FROM r CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS tree) t LEFT JOIN bag ON bag.tree = t.tree AND bag.row_id = r.row_id GROUP BY 1")
def bag_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered_customers(spark, sf_dir)
    return sampling.bags(df, df.count(), 3, 7).groupBy("tree").agg(F.count_if(F.col("n_drawn") > 0).alias("in_bag"), F.count_if(F.col("n_drawn") == 0).alias("out_of_bag"))


@query(f"WITH g AS (SELECT tree, f, row_number() OVER (PARTITION BY tree ORDER BY {HASH('concat_ws(chr(124), 3, tree, chr(49), f)')}, f) AS r FROM (SELECT unnest(generate_series(0, 4)) AS tree), (SELECT unnest(generate_series(0, 11)) AS f)) SELECT CAST(tree AS INTEGER) AS tree, string_agg(f, ',' ORDER BY r) AS features, CAST({HASH('concat_ws(chr(124), 3, ' + chr(39) + 'depth' + chr(39) + ', tree)')} % 48 + 3 AS INTEGER) AS depth_cap FROM g WHERE r <= 3 GROUP BY tree")
def feature_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(5).select(F.col("id").cast("int").alias("tree"), F.lit("1").alias("path"))
    return nodes.select("tree", F.array_join(sampling.sampled_features(3, 12, 3).cast("array<string>"), ",").alias("features"), sampling.depth_cap(3, F.col("tree")).alias("depth_cap"))


def assigned(spark: SparkSession, sf_dir: str, label: str = "l_returnflag") -> DataFrame:
    """All lines in one root node; rows whose key divides by 3 are out of the bag."""
    df = lines(spark, sf_dir)
    y = sampling.label_code(label, sampling.classes_of(df, label)) if label == "l_returnflag" else F.col(label)
    got = small_encoder(spark, sf_dir).transform(df.withColumn("y", y))
    return got.select(F.lit(0).alias("tree"), F.lit("").alias("path"), (F.col("k") % 3 != 0).alias("is_train"), F.lit(1.0).alias("w"), "y", "bins", "k")


ROOT = SMALL_BINS + ", a AS (SELECT k, k % 3 <> 0 AS t, [b0, b1, b2] AS bins, l_extendedprice AS p, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM b), c AS (SELECT k, t, y, p, unnest([0, 1, 2]) AS feature, unnest(bins) AS bin FROM a)"
HIST = ROOT + ", h AS (SELECT feature, bin, count(*) FILTER (t) AS n_train, count(*) FILTER (NOT t) AS n_valid, count(*) FILTER (t AND y = 0)::DOUBLE AS m0, count(*) FILTER (t AND y = 1)::DOUBLE AS m1, count(*) FILTER (t AND y = 2)::DOUBLE AS m2 FROM c GROUP BY 1, 2)"


def root_histogram(spark: SparkSession, sf_dir: str, criterion: str = "gini", k: int = 3, label: str = "l_returnflag") -> DataFrame:
    rows = assigned(spark, sf_dir, label).withColumn("features", F.array(F.lit(0), F.lit(1), F.lit(2)))
    return histograms.histograms(rows, criterion, k)


@query(HIST + " SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, n_train, n_valid, m0, m1, m2 FROM h")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_histogram(spark, sf_dir).select("feature", "bin", "n_train", "n_valid", "m0", "m1", "m2")


@query(ROOT + ", s AS (SELECT count(*) FILTER (t) AS n, count(*) FILTER (t AND y = 0) AS a, count(*) FILTER (t AND y = 1) AS b, count(*) FILTER (t AND y = 2) AS c, count(*) FILTER (NOT t AND y = 0) AS va, count(*) FILTER (NOT t AND y = 1) AS vb, count(*) FILTER (NOT t AND y = 2) AS vc FROM a), p AS (SELECT *, (a + 0.5) / (n + 1.5) AS pa, (b + 0.5) / (n + 1.5) AS pb, (c + 0.5) / (n + 1.5) AS pc, a / n::DOUBLE AS qa, b / n::DOUBLE AS qb, c / n::DOUBLE AS qc FROM s) SELECT n AS n_train, round(1 - qa * qa - qb * qb - qc * qc, 6) AS gini, round(-(qa * ln(qa) + qb * ln(qb) + qc * ln(qc)), 6) AS entropy, round(pa, 6) AS p0, round(pb, 6) AS p1, round(pc, 6) AS p2, round(-(va * ln(pa) + vb * ln(pb) + vc * ln(pc)), 3) AS loss FROM p")
def node_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = histograms.node_totals(assigned(spark, sf_dir), "gini", 3)
    m = [F.get("w_train_k", i) for i in range(3)]
    p = impurity.forecast(m, "gini", 0.5)
    loss = impurity.loss([F.get("w_valid_k", i) for i in range(3)], [F.get(p, i) for i in range(3)], "gini")
    return t.select(F.col("n_samples_train").alias("n_train"), r6(impurity.impurity(m, "gini")).alias("gini"), r6(impurity.impurity(m, "entropy")).alias("entropy"), *(r6(F.get(p, i)).alias(f"p{i}") for i in range(3)), F.round(loss, 3).alias("loss"))


@query(ROOT + ", s AS (SELECT avg(p) FILTER (t) AS m, var_pop(p) FILTER (t) AS v FROM a) SELECT round(m, 3) AS mean, round(v / 1e6, 3) AS mse_e6, round((SELECT sum((p - m) * (p - m)) FROM a WHERE NOT t) / 1e12, 3) AS loss_e12 FROM s")
def regression_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = histograms.node_totals(assigned(spark, sf_dir, "l_extendedprice"), "mse", 0)
    m = [F.get("w_train_k", i) for i in range(3)]
    p = impurity.forecast(m, "mse")
    loss = impurity.loss([F.get("w_valid_k", i) for i in range(3)], [F.get(p, 0)], "mse")
    return t.select(F.round(F.get(p, 0), 3).alias("mean"), F.round(impurity.impurity(m, "mse") / 1e6, 3).alias("mse_e6"), F.round(loss / 1e12, 3).alias("loss_e12"))


SCAN = HIST + ", o AS (SELECT *, feature > 0 AS is_cat, CASE WHEN feature = 0 THEN bin::DOUBLE WHEN n_train > 0 THEN m1 / (m0 + m1 + m2) ELSE CAST('inf' AS DOUBLE) END AS key FROM h), w AS (SELECT *, sum(m0) OVER u AS l0, sum(m1) OVER u AS l1, sum(m2) OVER u AS l2, sum(n_valid) OVER u AS nv, sum(m0) OVER g AS a0, sum(m1) OVER g AS a1, sum(m2) OVER g AS a2, sum(n_valid) OVER g AS av FROM o WINDOW u AS (PARTITION BY feature ORDER BY key, bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY feature)), i AS (SELECT *, l0 + l1 + l2 AS wl, a0 + a1 + a2 - l0 - l1 - l2 AS wr FROM w), j AS (SELECT *, -wl * (1 - (l0 * l0 + l1 * l1 + l2 * l2) / (wl * wl)) - wr * (1 - ((a0 - l0) ^ 2 + (a1 - l1) ^ 2 + (a2 - l2) ^ 2) / (wr * wr)) AS gain FROM i WHERE n_train > 0 AND wl >= 5 AND wr >= 5 AND nv >= 5 AND av - nv >= 5)"


@query(SCAN + " SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(gain, 4) AS gain FROM j")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = histograms.scanned(root_histogram(spark, sf_dir), [False, True, True], "gini", 3)
    return histograms.candidates(scans, "gini", 3, min_samples_leaf=5).select("feature", "bin", F.round("gain", 4).alias("gain"))


BEST = SCAN + ", z AS (SELECT * FROM j ORDER BY round(gain, 6) DESC, feature, key, bin LIMIT 1)"


@query(BEST + " SELECT CAST(z.feature AS INTEGER) AS feature, CAST(z.bin AS INTEGER) AS bin_threshold, is_cat AS is_split_categorical, (SELECT string_agg(o.bin, ',' ORDER BY o.bin) FROM o WHERE is_cat AND o.feature = z.feature AND n_train > 0 AND (o.key < z.key OR (o.key = z.key AND o.bin <= z.bin))) AS bin_partition, round(gain, 4) AS gain FROM z")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = histograms.scanned(root_histogram(spark, sf_dir), [False, True, True], "gini", 3)
    best = histograms.best_splits(scans, "gini", 3, min_samples_leaf=5)
    return best.select("feature", "bin_threshold", "is_split_categorical", F.array_join(F.col("bin_partition").cast("array<string>"), ",").alias("bin_partition"), F.round("gain", 4).alias("gain"))


@query(BEST + ", q AS (SELECT count(*) FILTER (t)::DOUBLE AS n, 1 - pow(count(*) FILTER (t AND y = 0) / count(*) FILTER (t)::DOUBLE, 2) - pow(count(*) FILTER (t AND y = 1) / count(*) FILTER (t)::DOUBLE, 2) - pow(count(*) FILTER (t AND y = 2) / count(*) FILTER (t)::DOUBLE, 2) AS g FROM a) SELECT round(g + gain / n, 6) AS information_gain FROM z, q")
def information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = histograms.scanned(root_histogram(spark, sf_dir), [False, True, True], "gini", 3)
    cut = histograms.candidates(scans, "gini", 3, min_samples_leaf=5).orderBy(F.round("gain", 6).desc(), "feature", "key", "bin").limit(1)
    names = histograms.names_of("gini", 3)
    left, right, node = [F.col(f"{m}_l") for m in names], [F.col(f"{m}_a") - F.col(f"{m}_l") for m in names], [F.col(f"{m}_a") for m in names]
    w = impurity.weight_of(node, "gini")
    gain = impurity.information_gain(w, impurity.impurity(node, "gini"), w, impurity.weight_of(left, "gini"), F.col("impurity_left"), impurity.weight_of(right, "gini"), F.col("impurity_right"))
    return cut.select(r6(gain).alias("information_gain"))


def keyed_scan(key: str) -> str:
    """SCAN with another order of categories."""
    return SCAN.replace("m1 / (m0 + m1 + m2)", key)


@query(f"{keyed_scan('m0 / (m0 + m1 + m2)')}, x0 AS (SELECT 0 AS scan, feature, bin, gain FROM j WHERE feature > 0) SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(gain, 4) AS gain FROM x0")
def all_strategy_first_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in the order of class 0, one of the scans that the strategy `all` makes."""
    scans = histograms.scanned(root_histogram(spark, sf_dir), [False, True, True], "gini", 3, "all")
    return histograms.candidates(scans, "gini", 3, min_samples_leaf=5).where("scan = 0 and feature > 0").select("feature", "bin", F.round("gain", 4).alias("gain"))


@query(f"""{keyed_scan("[m0, m1, m2][(" + HASH("concat_ws('|', 4, 'class', 0, '', feature)") + " % 3)::INT + 1] / (m0 + m1 + m2)")} SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(gain, 4) AS gain FROM j""")
def random_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = histograms.scanned(root_histogram(spark, sf_dir), [False, True, True], "gini", 3, "random", 4)
    return histograms.candidates(scans, "gini", 3, min_samples_leaf=5).select("feature", "bin", F.round("gain", 4).alias("gain"))


@query(BEST + ", s AS (SELECT a.k, CASE WHEN z.is_cat THEN a.bins[z.feature + 1] IN (SELECT o.bin FROM o, z WHERE o.feature = z.feature AND o.n_train > 0 AND (o.key < z.key OR (o.key = z.key AND o.bin <= z.bin))) ELSE a.bins[z.feature + 1] <= z.bin END AS l FROM a, z) SELECT k, CASE WHEN l THEN '1' ELSE '0' END AS path FROM s")
def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = histograms.scanned(root_histogram(spark, sf_dir), [False, True, True], "gini", 3)
    best = histograms.best_splits(scans, "gini", 3, min_samples_leaf=5)
    return histograms.routed(assigned(spark, sf_dir), F.broadcast(best)).select("k", "path")


@query(ROOT + ", h AS (SELECT feature, bin, count(*) FILTER (t) AS n, sum(p) FILTER (t) AS s, sum(p * p) FILTER (t) AS q, count(*) FILTER (NOT t) AS v FROM c GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER u AS nl, sum(s) OVER u AS sl, sum(q) OVER u AS ql, sum(v) OVER u AS vl, sum(n) OVER g AS na, sum(s) OVER g AS sa, sum(q) OVER g AS qa, sum(v) OVER g AS va FROM h WHERE feature = 0 WINDOW u AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY feature)) SELECT CAST(bin AS INTEGER) AS bin, round((-nl * (ql / nl - (sl / nl) * (sl / nl)) - (na - nl) * ((qa - ql) / (na - nl) - ((sa - sl) / (na - nl)) * ((sa - sl) / (na - nl)))) / 1e12, 4) AS gain_e12 FROM w WHERE n > 0 AND nl >= 5 AND na - nl >= 5 AND vl >= 5 AND va - vl >= 5")
def regression_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = histograms.scanned(root_histogram(spark, sf_dir, "mse", 0, "l_extendedprice"), [False, True, True], "mse", 0)
    return histograms.candidates(scans, "mse", 0, min_samples_leaf=5).where("feature = 0").select("bin", F.round(F.col("gain") / 1e12, 4).alias("gain_e12"))


#: A fixed tree: path, loss out of the bag, forecast.
TREE = [("", 5.0, 0.5), ("1", 1.5, 0.3), ("0", 2.5, 0.7), ("01", 0.4, 0.1), ("00", 0.6, 0.95)]


@query("WITH l(path, loss, y) AS (VALUES " + ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE)" for p, a, b in TREE) + "), s AS (SELECT max(step) AS step FROM (VALUES (1.0::DOUBLE)) t(step)), b AS (SELECT greatest(-2.5, -1.0) + ln((1 + exp(-abs(-2.5 - -1.0))) / 2) AS b), r AS (SELECT b, greatest(-5.0, -1.5 + b) + ln((1 + exp(-abs(-5.0 - (-1.5 + b)))) / 2) AS r FROM b), a AS (SELECT b, r, 0.5 * exp(-5.0 - r) AS ar, 0.5 * exp(-2.5 - b) AS ab FROM r) SELECT '1' AS path, round(ar * 0.5 + (1 - ar) * 0.3, 6) AS prediction, round((1 - ar) * 1, 6) AS weighted_depth FROM a UNION ALL SELECT '01', round(ar * 0.5 + (1 - ar) * (ab * 0.7 + (1 - ab) * 0.1), 6), round((1 - ar) * (ab * 1 + (1 - ab) * 2), 6) FROM a UNION ALL SELECT '00', round(ar * 0.5 + (1 - ar) * (ab * 0.7 + (1 - ab) * 0.95), 6), round((1 - ar) * (ab * 1 + (1 - ab) * 2), 6) FROM a")
def pruning_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = {"1", "01", "00"}
    nodes = spark.createDataFrame([(0, p, len(p), p in leaves, loss, [y], i) for i, (p, loss, y) in enumerate(TREE)], "tree int, path string, depth int, is_leaf boolean, loss_valid double, y_pred array<double>, node_id int")
    got = aggregation.leaf_predictions(aggregation.log_weights(nodes))
    return got.select("path", r6(F.get("prediction", 0)).alias("prediction"), r6("weighted_depth").alias("weighted_depth"))


SCORED = "scored AS (SELECT l_orderkey * 10 + l_linenumber AS k, CAST(l_linestatus = 'O' AS INTEGER) AS y, l_quantity AS s, CASE WHEN l_quantity > 25 THEN 'A' WHEN l_quantity > 10 THEN 'N' ELSE 'R' END AS guess, l_returnflag AS truth, l_extendedprice AS p, 1500 * l_quantity AS g FROM lineitem)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("y"), q.alias("s"), F.when(q > 25, "A").when(q > 10, "N").otherwise("R").alias("guess"), F.col("l_returnflag").alias("truth"), F.col("l_extendedprice").alias("p"), (1500 * q).alias("g"))


@query(f"WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM scored) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, sf_dir), "y", "s").select(r6("roc_auc").alias("roc_auc"))


@query(f"WITH {SCORED}, g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM scored GROUP BY s), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS n FROM g) SELECT round(sum(tp / n::DOUBLE * pos) / sum(pos), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir), "y", "s").select(r6("average_precision").alias("average_precision"))


#: Probabilities of three classes that are made up from the quantity.
THREE = f"WITH {SCORED}, t AS (SELECT CASE truth WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, [s / 100, 0.5 - s / 200, 0.5 - s / 200 + p / 1e7] AS ps FROM scored), e AS (SELECT k, c = k AS y, ps[k + 1] AS s FROM t, (SELECT unnest([0, 1, 2]) AS k)), r AS (SELECT k, y, s, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM e), a AS (SELECT k, count(*) FILTER (y) AS n, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS roc_auc FROM r GROUP BY k), g AS (SELECT k, s, count(*) FILTER (y) AS pos, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT k, pos, sum(pos) OVER (PARTITION BY k ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY k ORDER BY s DESC) AS n FROM g), b AS (SELECT k, sum(tp / n::DOUBLE * pos) / sum(pos) AS average_precision FROM c GROUP BY k)"


def three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("s"), F.col("p")
    return scored(spark, sf_dir).select(sampling.label_code("truth", ["A", "N", "R"]).alias("c"), F.array(s / 100, 0.5 - s / 200, 0.5 - s / 200 + p / 1e7).alias("ps"))


@query(f"{THREE} SELECT CAST(k AS INTEGER) AS k, n, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM a JOIN b USING (k)")
def class_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.class_aucs(three_classes(spark, sf_dir), "c", "ps", 3)
    return got.select("k", "n", r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))


@query(f"{THREE} SELECT round(avg(roc_auc), 6) AS auc_macro, round(sum(roc_auc * n) / sum(n), 6) AS auc_weighted, round(avg(average_precision), 6) AS ap_macro, round(sum(average_precision * n) / sum(n), 6) AS ap_weighted FROM a JOIN b USING (k)")
def multiclass_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.class_aucs(three_classes(spark, sf_dir), "c", "ps", 3)
    auc, ap = metrics.averaged(got, "roc_auc"), metrics.averaged(got, "average_precision")
    return auc.select(r6("macro").alias("auc_macro"), r6("weighted").alias("auc_weighted")).crossJoin(ap.select(r6("macro").alias("ap_macro"), r6("weighted").alias("ap_weighted")))


@query(f"{THREE.split(', r AS')[0]}, pr AS (SELECT a, b, unnest([a, b]) AS one FROM (VALUES (0, 1), (0, 2), (1, 2)) x(a, b)), m AS (SELECT a, b, one, c = one AS y, ps[one + 1] AS s FROM t JOIN pr ON c = a OR c = b), r AS (SELECT *, rank() OVER (PARTITION BY a, b, one ORDER BY s) + (count(*) OVER (PARTITION BY a, b, one, s) - 1) / 2.0 AS r FROM m), u AS (SELECT (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM r GROUP BY a, b, one) SELECT round(avg(auc), 6) AS auc_ovo FROM u")
def pairwise_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.multiclass_auc(three_classes(spark, sf_dir), "c", "ps", 3, how="ovo")
    return spark.createDataFrame([(round(got, 6),)], "auc_ovo double")


@query(f"WITH {SCORED} SELECT round(avg(-ln(CASE WHEN y = 1 THEN s / 51 ELSE 1 - s / 51 END)), 6) AS log_loss, round(avg((truth = guess)::INT), 6) AS accuracy FROM scored")
def loss_and_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumn("p", F.array(1 - F.col("s") / 51, F.col("s") / 51))
    return metrics.log_loss(df, "y", "p").crossJoin(metrics.accuracy(df, "truth", "guess")).select(r6("log_loss").alias("log_loss"), r6("accuracy").alias("accuracy"))


@query(f"WITH {SCORED} SELECT round(avg((p - g) * (p - g)) / 1e6, 4) AS mse_e6, round(avg(abs(p - g)), 4) AS mae, round(1 - sum((p - g) * (p - g)) / (var_pop(p) * count(*)), 6) AS r2 FROM scored")
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors(scored(spark, sf_dir), "p", "g").select(F.round(F.col("mse") / 1e6, 4).alias("mse_e6"), F.round("mae", 4).alias("mae"), r6("r2").alias("r2"))


@query(f"WITH {SCORED} SELECT truth, guess, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), "truth", "guess")


@query(f"WITH {SCORED}, k AS (SELECT DISTINCT truth AS label FROM scored), c AS (SELECT label, count(*) FILTER (truth = label AND guess = label)::DOUBLE AS tp, count(*) FILTER (truth = label) AS t, count(*) FILTER (guess = label) AS g FROM scored, k GROUP BY label) SELECT label, round(tp / g, 6) AS precision, round(tp / t, 6) AS recall, round(2 * tp / (t + g), 6) AS f1, t AS support FROM c")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.report(scored(spark, sf_dir), "truth", "guess")
    return got.select("label", *(r6(c).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1")
def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 6))
    return got


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return df.unpivot("p_partkey", ["p_size", "p_retailprice"], "variable", "value")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS c_acctbal_mean, round(stddev_pop(c_acctbal), 6) AS c_acctbal_std FROM customer GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.summary(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_acctbal"])
    return got.select("c_mktsegment", r6("c_acctbal_mean").alias("c_acctbal_mean"), r6("c_acctbal_std").alias("c_acctbal_std"))


@query("SELECT a AS step, b AS dirichlet FROM (VALUES (0.1::DOUBLE), (1.0), (10.0)) x(a), (VALUES (0.5::DOUBLE), (2.0)) y(b)")
def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grid(spark, step=[0.1, 1.0, 10.0], dirichlet=[0.5, 2.0])


@query(f"SELECT trial, [0.1::DOUBLE, 1.0, 10.0][({HASH("concat_ws('|', 5, trial, 'step')")} % 3)::INT + 1] AS step, [0.5::DOUBLE, 2.0][({HASH("concat_ws('|', 5, trial, 'dirichlet')")} % 2)::INT + 1] AS dirichlet FROM (SELECT unnest(generate_series(0, 19)) AS trial)")
def drawn_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drawn_settings(spark, 20, 5, step=[0.1, 1.0, 10.0], dirichlet=[0.5, 2.0])


def _terms(h: list[float], form: str) -> str:
    return " + ".join(form.format(h=a, t=b, w=c) for a, b, c in zip(h, signals.PLACES, signals.WIDTHS, strict=True))


@query("WITH x AS (SELECT i, i / 1000.0::DOUBLE + 0.0003 AS x FROM (SELECT unnest(generate_series(0, 998)) AS i)), s AS (SELECT i, 4 * sin(4 * pi() * x) - sign(x - 0.3) - sign(0.72 - x) AS h, " + _terms(signals.BUMPS, "{h} * pow(1 + abs((x - {t}) / {w}), -4)") + " AS b, " + _terms(signals.BLOCKS, "({h}) * (1 + sign(x - {t})) / 2") + " AS k, sqrt(x * (1 - x)) * sin(2.1 * pi() / (x + 0.05)) AS d FROM x) SELECT i, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS heavisine, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS bumps, round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()), 6) AS blocks, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS doppler FROM s")
def test_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(999).select(F.col("id").alias("i"), (F.col("id") / 1000.0 + 0.0003).alias("x"))
    for name, f in signals.SIGNALS.items():
        df = signals.rescaled(df.withColumn(name, f(F.col("x"))), name, name)
    return df.select("i", *(r6(n).alias(n) for n in signals.SIGNALS))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
#: What tells lines apart; lines alike in all of it may change places.
WHOLE_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines() with dense numbers for a key; the price is in ten thousands."""
    df = numbered(table(spark, sf_dir, "lineitem").select(*WHOLE_LINE), WHOLE_LINE, "k")
    return df.select("k", "l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_tax")).alias("l_tax"), "l_linestatus", "l_returnflag", (F.col("l_extendedprice") / 10000).alias("price"))


def lines_as(y: str, *features: str) -> str:
    """SQL of rows() for a forest: row_id, y and f0, f1, ..."""
    tax = "CASE WHEN l_orderkey % 17 <> 0 THEN l_tax END"
    cells = ", ".join(f"{tax if c == 'l_tax' else c} AS f{i}" for i, c in enumerate(features))
    return f"SELECT row_number() OVER (ORDER BY {', '.join(WHOLE_LINE)}) - 1 AS row_id, {y} AS y, {cells} FROM lineitem"


FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
CLASSIFY = Case(lines_as(FLAG, *FEATURES), [False, False, False, True, True], 2, 5, 4, 3)
REGRESS = Case(lines_as("l_extendedprice / 10000", "l_quantity", "l_discount", "l_tax", "l_returnflag"), [False, False, True, True], 4, 5, 5, 0)
WHAT_IF = replace(CLASSIFY, settings=((0.1, 0.5), (1.0, 0.5), (0.1, 5.0), (1.0, 5.0)))


def classifier(df: DataFrame, **settings: object) -> ForestModel:
    return ForestClassifier(**{"n_estimators": 5, "max_depth": 4, "max_bins": 64, "subsample": None, "categorical_features": ["l_tax", "l_linestatus"], **settings}).fit(df, "l_returnflag", key="k", features=FEATURES)


def regressor(df: DataFrame) -> ForestModel:
    return ForestRegressor(n_estimators=5, max_depth=5, max_bins=64, max_features=None, subsample=None, categorical_features=["l_tax", "l_returnflag"]).fit(df, "price", key="k", features=["l_quantity", "l_discount", "l_tax", "l_returnflag"])


SHARES = [f"p{i}" for i in range(3)]


@query(f"{forest(CLASSIFY)} SELECT row_id AS k, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS prediction, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM ({mean_prediction(CLASSIFY)})")
def forest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    got = classifier(df).predict(df, "k")
    return got.select("k", "prediction", *(r6(F.get("probabilities", i)).alias(c) for i, c in enumerate(SHARES)))


@query()
def forest_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    return classifier(df, multiclass="ovr", n_estimators=2, class_weight="balanced", criterion="entropy").predict_proba(df, "k")


@query(f"{forest(REGRESS)} SELECT row_id AS k, round(p0, 5) AS prediction, round(wd, 4) AS weighted_depth FROM ({mean_prediction(REGRESS)})")
def forest_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    return regressor(df).means(df, "k").select("k", F.round("prediction", 5).alias("prediction"), F.round("weighted_depth", 4).alias("weighted_depth"))


@query(f"{forest(CLASSIFY)} SELECT row_id AS k, CAST(tree AS INTEGER) AS tree, CAST(node_id AS INTEGER) AS leaf_id FROM at_leaf")
def forest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    return classifier(df).leaf_ids(df, "k")


@query()
def forest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    return classifier(df, n_estimators=2, max_depth=3).path_of(df, "k")


@query(f"{forest(CLASSIFY)}, tops AS (SELECT tree, max(depth) AS top FROM nodes GROUP BY 1), up AS (SELECT tree, path AS up, node_id AS parent FROM nodes) SELECT CAST(tree AS INTEGER) AS tree, CAST(node_id AS INTEGER) AS node_id, path, CAST(depth AS INTEGER) AS depth, CAST(coalesce(parent, -1) AS INTEGER) AS parent, leaf AS is_leaf, n_train AS n_samples_train, n_valid AS n_samples_valid, CAST(coalesce(f, -1) AS INTEGER) AS feature, CAST(coalesce(bin, -1) AS INTEGER) AS bin_threshold, coalesce(array_to_string(bins_left, ','), '') AS bin_partition, round(coalesce(gain, 0), 3) AS gain, round(loss, 3) AS loss, round(lw, 3) AS log_weight, round(m0, 3) AS m0, round(y1, 6) AS y1, CAST(top - depth AS INTEGER) AS y FROM nodes JOIN tops USING (tree) LEFT JOIN up USING (tree, up)".replace("LEFT JOIN up USING (tree, up)", "LEFT JOIN up ON up.tree = nodes.tree AND depth > 0 AND up.up = substr(path, 1, depth - 1)").replace("SELECT CAST(tree AS", "SELECT CAST(nodes.tree AS"))
def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = classifier(rows(spark, sf_dir))
    at = model.nodes.join(model.layout(), ["tree", "node_id"])
    none = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return at.select("tree", F.col("node_id").cast("int").alias("node_id"), "path", "depth", none("parent").cast("int").alias("parent"), "is_leaf", "n_samples_train", "n_samples_valid", none("feature").alias("feature"), none("bin_threshold").alias("bin_threshold"), F.coalesce(F.array_join(F.col("bin_partition").cast("array<string>"), ","), F.lit("")).alias("bin_partition"), F.round(F.coalesce("gain", F.lit(0.0)), 3).alias("gain"), F.round("loss_valid", 3).alias("loss"), F.round("log_weight_tree", 3).alias("log_weight"), F.round(F.get("w_train_k", 0), 3).alias("m0"), r6(F.get("y_pred", 1)).alias("y1"), F.col("y").cast("int").alias("y"))


@query(f"{forest(WHAT_IF)} SELECT step, dirichlet, round(avg(-ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM ({mean_prediction(WHAT_IF)}) JOIN src USING (row_id) GROUP BY 1, 2")
def forest_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir)
    coded = df.withColumn("code", sampling.label_code("l_returnflag", ["A", "N", "R"]))
    return metrics.what_if(classifier(df), coded, "k", "code", [0.1, 1.0], [0.5, 5.0]).withColumn("log_loss", r6("log_loss"))


@query()
def forest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 numbers from an array column, ten classes."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(f"x{i}") for i in range(64)))
    return ForestClassifier(n_estimators=5, max_depth=5, max_bins=32, cat_split_strategy="all", subsample=None).fit(df, "label", key="vec_id").predict(df, "vec_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_classify(spark, sf_dir)
