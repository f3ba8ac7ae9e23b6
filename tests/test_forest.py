import gzip
import math
import zipfile
from itertools import product

import pytest
from pyspark.sql import functions as F

from copse import queries
from copse.functions import checks, storage
from copse.operators import aggregation, metrics
from copse.operators.encoder import Encoder, fit_transform
from copse.operators.sampling import bootstrap, label_code, max_features, redrawn
from copse.plans import forest as forest_plan
from copse.plans.forest import ForestClassifier, ForestModel, ForestRegressor, Params
from copse.sources.tables import REGISTRY, read_csv, read_svmlight, write_csv

FRAME = [(0, "b", 3.0, "b", -4.0), (1, "a", 3.0, "a", 1.0), (1, "b", 0.0, "b", 2.0), (1, "c", -1.0, "c", 1.0), (0, "a", 42.0, "a", -3.0), (0, "a", 7.0, "a", 17.0), (0, "b", 1.0, "d", 2.0), (0, "c", 17.0, "c", 3.0), (1, "b", 8.0, "a", -1.0)]


@pytest.mark.parametrize(("max_bins", "c", "e", "bins_e"), [(5, [0.5, 3, 5, 12.5], [-2, 1, 1.5, 2.5], [0, 1, 3, 1, 0, 4, 3, 4, 1]), (256, [-0.5, 0.5, 2, 5, 7.5, 12.5, 29.5], [-3.5, -2, 0, 1.5, 2.5, 10], [0, 3, 4, 3, 1, 6, 4, 5, 2])])
def test_encoder_golden(spark, max_bins, c, e, bins_e):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FRAME)], "i int, A int, B string, C double, D string, E double")
    model = Encoder(max_bins=max_bins, is_categorical=[True, True, False, True, False]).fit(df, list("ABCDE"))
    assert model.cuts["C"] == c and model.cuts["E"] == e
    assert model.categories["B"] == ["a", "b", "c"]
    got = [r.bins for r in model.transform(df).orderBy("i").collect()]
    assert [b[4] for b in got] == bins_e
    assert [b[3] for b in got] == [1, 0, 1, 2, 0, 0, 3, 2, 0]


def test_subsample_draws_equal_rows_evenly(spark):
    df = spark.range(120_000).select(F.greatest(F.col("id") - 40_000, F.lit(0)).cast("double").alias("x"))
    for seed in range(2):
        cuts = Encoder(max_bins=4, is_categorical=[False], subsample=50_000, seed=seed).fit(df).cuts["x"]
        assert cuts == pytest.approx([0, 20_000, 50_000], abs=1_000)


def test_registered_forests_take_all_rows(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ForestClassifier, "fit", lambda self, *a, **b: made.append(self.params.subsample))
    queries.classifier(None)
    assert made == [None]


def test_encoder_missing_unknown_and_inverse(spark):
    df = spark.createDataFrame([(None, 3.0, -4.0), ("a", None, 1.0), ("b", 0.0, 2.0), (None, -1.0, 1.0), ("a", 42.0, -3.0), ("a", 7.0, float("nan")), ("d", 1.0, 2.0), ("c", None, 3.0)], "a string, b double, d double")
    model = Encoder(max_bins=4, is_categorical=["b"], handle_unknown="consider_missing").fit(df)
    assert [r.bins for r in model.transform(df).collect()] == [[4, 3, 0], [0, 6, 1], [1, 1, 2], [4, 0, 1], [0, 5, 0], [0, 4, 4], [3, 2, 2], [2, 6, 3]]
    new = spark.createDataFrame([("x", 5.0, 9.0)], df.schema)
    assert model.transform(new).first().bins == [4, 6, 3]
    back = model.inverse(model.transform(df)).collect()
    assert back[0].b_value == 3.0 and back[1].b_value is None and back[2].d_interval.right == 2.0
    strict = Encoder(is_categorical=["b"]).fit(df)
    with pytest.raises(ValueError, match="unknown categories"):
        strict.transform(new)
    with pytest.raises(ValueError, match="can't be a feature"):
        checks.features_of(spark.sql("SELECT date '2020-01-01' AS d"))


def test_role_inference(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"), F.lit("x").alias("name"), F.lit(True).alias("flag"))
    assert checks.roles(df, df.columns) == [True, False, True, True]
    assert checks.roles(df, df.columns, [False, True, False, False]) == [False, True, True, True]
    assert checks.category_limit("sqrt", 100) == 10
    with pytest.raises(ValueError):
        checks.categorical_mask([9], ["a"])


def test_typing_warnings_and_array_rule(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("few"), F.col("id").cast("string").alias("many"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 2).alias("number"))
    with pytest.warns(UserWarning, match="few is categorical"):
        assert checks.roles(df, df.columns, [False] * 4, verbose=True) == [True, True, True, False]
    with pytest.warns(UserWarning, match="number is taken as numeric"):
        checks.roles(df, df.columns, verbose=True)
    assert checks.array_roles(df, df.columns) == [True, False, True, False]
    assert checks.array_roles(df, ["many", "few"], [False, True]) == [False, True]
    with pytest.raises(ValueError, match="no number"):
        checks.array_roles(df, ["name"], [False])


def test_register_reads_layouts(spark, tmp_path):
    (tmp_path / "cardiotocography.csv.gz").write_bytes(gzip.compress(b"FileName;Date;SegFile;MSTV;MLTV;CLASS;NSP\nf;d;s;0,5;2,25;3;1\n"))
    (tmp_path / "smoke_detection_iot.csv").write_text(",UTC,CNT,Fire Alarm\n0,1,2,1\n")
    got, label = REGISTRY.load(spark, "cardio", f"file://{tmp_path}")
    assert label == "CLASS" and [tuple(r) for r in got.collect()] == [(0.5, 2.25, 3)]
    got, label = REGISTRY.load(spark, "smoke", f"file://{tmp_path}")
    assert got.columns == ["CNT", "Fire Alarm"] and "heart2" in REGISTRY.names()
    with pytest.raises(ValueError, match="no source"):
        REGISTRY.load(spark, "unknown", "")
    with zipfile.ZipFile(tmp_path / "bank.zip", "w") as z:
        z.writestr("bank-full.csv", "age;y\n30;no\n40;yes\n")
    got, label = REGISTRY.load(spark, "bank", f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == [(30, "no"), (40, "yes")] and label == "y"
    (tmp_path / "sparse.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    assert [r.label for r in read_svmlight(spark, f"file://{tmp_path}/sparse.txt", 3).collect()] == [1.0, 0.0]


def test_over_seeds(spark):
    got = metrics.over_seeds(lambda s: spark.range(2).select((F.col("id") + s).cast("double").alias("v")), [1, 5])
    assert metrics.summary(got, ["seed"], ["v"]).orderBy("seed").collect()[1].v_mean == 5.5


@pytest.mark.parametrize("bad", [{"n_estimators": 0}, {"step": 0.0}, {"max_depth": 1}, {"dirichlet": 0.0}, {"min_samples_leaf": 0}, {"max_bins": 2}, {"class_weight": "x"}, {"random_state": -1}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_max_features():
    assert [max_features(x, 54) for x in ("auto", "log2", None, 7, 0.5)] == [7, 5, 54, 7, 27]
    with pytest.raises(ValueError):
        max_features(99, 5)


def prunings(tree, path=""):
    """All prunings of a tree below path: lists of leaves, and how many inner nodes were tried."""
    yield [path]
    if path + "1" in tree:
        for a, b in product(list(prunings(tree, path + "1")), list(prunings(tree, path + "0"))):
            yield a + b


def test_average_is_that_over_all_prunings(spark):
    tree = {"": (5.0, 0.5), "1": (1.5, 0.3), "0": (2.5, 0.7), "01": (0.4, 0.1), "00": (0.6, 0.95), "11": (0.9, 0.35), "10": (0.2, 0.15)}
    rows = [(0, p, len(p), p + "1" not in tree, loss, [y], i) for i, (p, (loss, y)) in enumerate(tree.items())]
    nodes = spark.createDataFrame(rows, "tree int, path string, depth int, is_leaf boolean, loss_valid double, y_pred array<double>, node_id int")
    got = {r.path: r.prediction[0] for r in aggregation.leaf_predictions(aggregation.log_weights(nodes, 0.7), 0.7).collect()}
    for leaf in ("01", "00", "11", "10"):
        top = bottom = 0.0
        for leaves in prunings(tree):
            # Each node above or at a pruning's leaves that could have been split halves its prior.
            inner = {x[:k] for x in leaves for k in range(len(x))} | {x for x in leaves if x + "1" in tree}
            w = 0.5 ** len(inner) * math.exp(-0.7 * sum(tree[x][0] for x in leaves))
            top += w * tree[next(x for x in leaves if leaf.startswith(x))][1]
            bottom += w
        assert got[leaf] == pytest.approx(top / bottom, rel=1e-12)


@pytest.fixture(scope="module")
def data(spark):
    x, g = F.col("id") % 37, F.col("id") % 5
    return spark.range(600).select("id", x.cast("double").alias("x"), F.when(g != 4, g.cast("string")).alias("g"), F.when((x > 20) | (g == 2), "yes").otherwise(F.when(x > 10, "maybe").otherwise("no")).alias("y"), (x * 2 + g).alias("t")).cache()


@pytest.fixture(scope="module")
def model(data):
    return ForestClassifier(n_estimators=4, max_depth=5, max_features=None).fit(data, "y", key="id", features=["x", "g"])


def test_forest_learns_and_nodes_are_sound(data, model):
    got = model.predict(data, "id").join(data, "id")
    assert got.where("prediction = y").count() > 570
    for p in (r.probabilities for r in got.take(20)):
        assert sum(p) == pytest.approx(1)
    nodes = {(r.tree, r.node_id): r for r in model.nodes.collect()}
    for (tree, i), r in nodes.items():
        if r.is_leaf:
            continue
        left, right = nodes[tree, r.left_child], nodes[tree, r.right_child]
        assert left.parent == right.parent == i < min(left.node_id, right.node_id) and left.depth == r.depth + 1
        assert left.n_samples_train + right.n_samples_train == r.n_samples_train
        assert left.n_samples_valid + right.n_samples_valid == r.n_samples_valid and min(left.n_samples_train, left.n_samples_valid) >= 1


def test_score_and_what_if(data, model):
    said = {r.id: r.prediction for r in model.predict(data, "id").collect()}
    assert model.score(data, "y", "id") == pytest.approx(sum(said[r.id] == r.y for r in data.collect()) / 600)
    coded = data.withColumn("code", label_code("y", model.classes))
    got = {(r.step, r.dirichlet): r.log_loss for r in metrics.what_if(model, coded, "id", "code", [0.3, 1.0], [2.0]).collect()}
    one = model.with_settings(step=0.3, dirichlet=2.0).predict_proba(data, "id").join(coded.select("id", "code"), "id")
    assert set(got) == {(0.3, 2.0), (1.0, 2.0)} and got[0.3, 2.0] == pytest.approx(metrics.log_loss(one, "code", "probabilities").first()[0])
    line = ForestRegressor(n_estimators=3, max_depth=4, max_features=None).fit(data, "t", key="id", features=["x", "g"])
    assert 0.9 < line.score(data, "t", "id") <= 1
    assert line.size_bytes() > 1000


def test_a_bag_leaves_a_row_out(spark):
    df = spark.range(3).withColumnRenamed("id", "row_id")
    again = redrawn(3, 40, 1)
    assert again
    sizes = {r.tree: r["count"] for r in bootstrap(df, 3, 40, 1).groupBy("tree").count().collect()}
    assert len(sizes) == 40 and max(sizes.values()) < 3 and redrawn(1, 5, 0) == {}


def test_rows_alike_are_grown_as_one(spark, monkeypatch):
    """What trees are grown from is bounded by bins and classes, and stands for every row of each tree."""
    made = []

    def stop(assign, rules):
        made.append(assign)
        raise InterruptedError

    monkeypatch.setattr(forest_plan, "grow", stop)
    df = spark.range(2000).select("id", (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    with pytest.raises(InterruptedError):
        ForestClassifier(n_estimators=4, categorical_features=[False]).fit(df, "y", key="id")
    rows = made[0].collect()
    assert len(rows) <= 4 * 2 * 3 * 2
    for t in range(4):
        of = [r for r in rows if r.tree == t]
        assert sum(r.n for r in of) == 2000 == sum(r.w for r in of if r.is_train)
    want = {(r.tree, r.row_id % 3, r.row_id % 2): 0 for r in bootstrap(spark.range(2000).withColumnRenamed("id", "row_id"), 2000, 4, 0).collect()}
    for r in bootstrap(spark.range(2000).withColumnRenamed("id", "row_id"), 2000, 4, 0).collect():
        want[r.tree, r.row_id % 3, r.row_id % 2] += r.n_drawn
    assert {(r.tree, r.bins[0], r.y): r.w for r in rows if r.is_train} == want


def test_fit_transform_is_fit_then_transform(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"))
    model, coded = fit_transform(Encoder(max_bins=5, is_categorical=[False]), df)
    assert [r.bins for r in coded.collect()] == [r.bins for r in model.transform(df).collect()]


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    session = type("Session", (), {"conf": {}, "sparkContext": Context})()
    with pytest.raises(ValueError, match="all machines share"):
        storage.shared_dir(session)


def test_changed_settings_equal_a_refit(data, model):
    again = ForestClassifier(n_estimators=4, max_depth=5, max_features=None, dirichlet=2.0, step=0.3).fit(data, "y", key="id", features=["x", "g"])
    a = {r.id: r.probabilities for r in model.with_settings(dirichlet=2.0, step=0.3).predict_proba(data, "id").collect()}
    for r in again.predict_proba(data, "id").collect():
        assert r.probabilities == pytest.approx(a[r.id])


def test_save_and_load(spark, data, model, tmp_path):
    model.save(f"file://{tmp_path}/m")
    a = {r.id: r.prediction for r in model.predict(data, "id").collect()}
    assert a == {r.id: r.prediction for r in ForestModel.load(spark, f"file://{tmp_path}/m").predict(data, "id").collect()}


def test_one_vs_rest_and_regression(data):
    ovr = ForestClassifier(n_estimators=2, max_depth=4, multiclass="ovr", class_weight="balanced", max_features=None).fit(data, "y", key="id", features=["x", "g"])
    assert ovr.predict(data, "id").join(data, "id").where("prediction = y").count() > 540
    reg = ForestRegressor(n_estimators=3, max_depth=6, max_features=None).fit(data, "t", key="id", features=["x", "g"])
    got = metrics.errors(reg.predict(data, "id").join(data, "id"), "t", "prediction").first()
    assert got.r2 > 0.95
    assert reg.weighted_depth(data, "id").agg(F.max("weighted_depth")).first()[0] <= 6


def test_empty_and_constant(spark, data):
    with pytest.raises(ValueError, match="no labelled rows"):
        ForestClassifier().fit(data.where("false"), "y", key="id", features=["x"])
    flat = ForestRegressor(n_estimators=2).fit(data.withColumn("c", F.lit(0.1)), "c", key="id", features=["x"])
    assert flat.depth <= 1 and flat.predict(data, "id").first().prediction == pytest.approx(0.1)


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.625)
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx((0.5 + 2 / 3) / 2)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "?", "1,5"), (2, "b", "2,25")], "i int, t string, d string")
    write_csv(df, f"file://{tmp_path}/c")
    got = read_csv(spark, f"file://{tmp_path}/c", "i int, t string, d string", missing="?", decimal_comma=["d"]).orderBy("i").collect()
    assert [(r.t, r.d) for r in got] == [(None, 1.5), ("b", 2.25)]


def test_stream_is_binned_like_a_table(spark, data, tmp_path):
    from copse.streaming.scoring import binned

    data.select("id", "x").write.parquet(f"file://{tmp_path}/in")
    enc = Encoder(is_categorical=[False]).fit(data, ["x"])
    stream = binned(spark.readStream.schema("id long, x double").parquet(f"file://{tmp_path}/in"), enc)
    q = stream.writeStream.format("memory").queryName("binned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {r.id: r.bins for r in enc.transform(data.select("id", "x")).collect()}
    assert {r.id: r.bins for r in spark.table("binned").collect()} == want


def test_entry_without_extras():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "forest_classify" in e.queries()
