import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weirworks.operators import charts, clusters, features, linear_folds, lloyd, nested, parzen, regression, tuning
from weirworks.operators.ensembles import AdaBoostR2, StackingRegressor, VotingRegressor
from weirworks.operators.forests import forest
from weirworks.session import fit_input
from weirworks.sources import sinks

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, [1, 5, 0.2], (400, 3))
    y = 3 * x[:, 0] - x[:, 1] + 2 + np.where(x[:, 2] > 0, 4, 0) + rng.normal(0, 0.3, 400)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").cache()


def scaled(pandas):
    x = pandas[FEATURES].to_numpy()
    return (x - x.mean(0)) / x.std(0)


def test_splits_depend_on_the_key_only(data):
    one = regression.mark_split(regression.mark_folds(data.coalesce(1), "id"), "id")
    many = regression.mark_split(regression.mark_folds(data.repartition(7), "id"), "id")
    pick = lambda df: sorted((r.id, r.fold, r.is_train) for r in df.collect())
    assert pick(one) == pick(many)
    sizes = one.groupBy("fold").count().collect()
    assert sum(r["count"] for r in sizes) == 400 and len(sizes) == 5
    assert 0.7 < one.filter("is_train").count() / 400 < 0.9


def test_ridge_matches_the_closed_form(data):
    pandas = data.toPandas()
    x, y = scaled(pandas), pandas.y.to_numpy()
    want = np.linalg.solve(x.T @ x + np.eye(3), x.T @ (y - y.mean()))
    model = regression.scaled_pipeline(FEATURES, regression.make_regressor("ridge", "y")).fit(data)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(want, rel=1e-8)


def test_lasso_matches_coordinate_descent(data):
    pandas = data.toPandas()
    x, y = scaled(pandas), pandas.y.to_numpy() - pandas.y.mean()
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rest = y - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 1.0, 0) / (x[:, j] @ x[:, j] / len(y))
    model = regression.scaled_pipeline(FEATURES, regression.make_regressor("lasso", "y")).fit(data)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(w, abs=1e-5)


def test_linear_terms_are_in_raw_units(data):
    pandas = data.toPandas()
    design = np.column_stack([np.ones(400), pandas[FEATURES].to_numpy()])
    want = np.linalg.lstsq(design, pandas.y.to_numpy(), rcond=None)[0]
    model = regression.scaled_pipeline(FEATURES, regression.make_regressor("linear_regression", "y")).fit(data)
    got = {r.term: r.value for r in regression.linear_terms(model, FEATURES, data).collect()}
    assert [got["intercept"], *[got[f] for f in FEATURES]] == pytest.approx(want, rel=1e-8)


def r2(model, data):
    return regression.regression_metrics(model.transform(data), "y", "prediction").first().r2


def test_adaboost_beats_a_single_tree(data):
    boosted = regression.scaled_pipeline(FEATURES, AdaBoostR2("y", rounds=8, checkpoint_every=3)).fit(data)
    single = regression.scaled_pipeline(FEATURES, AdaBoostR2("y", rounds=1)).fit(data)
    assert len(boosted.stages[-1].trees) > 1 and r2(boosted, data) > r2(single, data) > 0.5


def test_weighted_median(spark, data):
    class Fixed:
        def __init__(self, value):
            self.value = value

        def setPredictionCol(self, name):
            self.name = name
            return self

        def transform(self, df):
            return df.withColumn(self.name, F.lit(self.value))

    from weirworks.operators.ensembles import WeightedMedianModel

    model = WeightedMedianModel([Fixed(1.0), Fixed(9.0), Fixed(5.0)], [1.0, 1.0, 3.0])
    assert model.transform(spark.range(1)).first().prediction == 5.0


def test_voting_is_the_mean(data):
    members = {n: regression.make_regressor(n, "y") for n in ("linear_regression", "ridge")}
    voted = regression.scaled_pipeline(FEATURES, VotingRegressor(members)).fit(data)
    both = [regression.scaled_pipeline(FEATURES, m).fit(data).transform(data) for m in members.values()]
    mean = [(a.prediction + b.prediction) / 2 for a, b in zip(both[0].orderBy("id").collect(), both[1].orderBy("id").collect())]
    assert [r.prediction for r in voted.transform(data).orderBy("id").collect()] == pytest.approx(mean)


def test_stacking_learns(data):
    members = {n: regression.make_regressor(n, "y") for n in ("linear_regression", "ridge")}
    rows = regression.mark_folds(data, "id", 3)
    stacked = regression.scaled_pipeline(FEATURES, StackingRegressor(members, "y", folds=3, trees=10)).fit(rows)
    assert r2(stacked, data) > 0.6


def test_predictions_keep_every_key(spark, data, tmp_path):
    model, metrics = regression.train_regressor(data, "id", FEATURES, "y", trees=10)
    assert metrics.first().r2 > 0
    gaps = data.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    scored = regression.batch_predict(model, gaps, "id", FEATURES)
    assert scored.count() == 400 and scored.filter("prediction is null").count() == 40
    stored = sinks.load_model(spark, sinks.save_model(model, str(tmp_path / "model")))
    assert regression.batch_predict(stored, gaps, "id", FEATURES).exceptAll(scored).count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.load_model(spark, str(tmp_path / "nothing"))


def test_comparison_keeps_failing_models(data):
    found = {
        r.model: r for r in tuning.compare_models(data, "id", FEATURES, "y", ["linear_regression", "unknown"], folds=2).collect()
    }
    assert found["unknown"].error.startswith("ValueError: unknown model") and found["linear_regression"].best
    assert not found["unknown"].best


def test_cut_forests_predict_like_smaller_ones(spark, data):
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data)
    values = np.array(data.orderBy("id").select(*FEATURES).collect())
    predicted = lambda model: [r.prediction for r in model.transform(assembled).orderBy("id").collect()]
    for leaf in (1, 3):
        grown = forest("y", 12, None, 7, min_leaf=leaf).fit(assembled)
        path = nested.stored_nodes(grown, spark)
        nodes = nested.Nodes(spark, path)
        for depth in (1, 4, 9):
            refitted = forest("y", 12, depth, 7, min_leaf=leaf).fit(assembled)
            assert np.allclose(nodes.predict(values, [nested.Cut(12, depth)])[0], predicted(refitted))
        whole = nodes.predict(values, [nested.Cut(12, 30), nested.Cut(5, 30)])
        assert np.allclose(whole[0], predicted(grown))
        assert np.allclose(whole[1], np.mean([[t.predict(Vectors.dense(v)) for t in grown.trees[:5]] for v in values], axis=1))
        assert np.allclose(nested.Nodes(spark, path, 5).predict(values, [nested.Cut(5, 30)])[0], whole[1])
    table = nested.node_table(spark, path)
    assert table.count() == grown.totalNumNodes and table.where("parent IS NULL").count() == 12
    # A smallest split ends every walk at the first node with fewer rows.
    by = {(r.tree, r.node): r for r in table.collect()}

    def walk(tree, v, split):
        node = by[tree, 0]
        while node.feature is not None and node.rows >= split:
            node = by[tree, node.left if v[node.feature] <= node.border else node.right]
        return node.prediction

    cut = nodes.predict(values[:40], [nested.Cut(12, 30, 25)])[0]
    assert np.allclose(cut, [np.mean([walk(t, v, 25) for t in range(12)]) for v in values[:40]])


def test_search_scores_every_point(data):
    assert len(tuning.grid_points()) == 108
    grid = {"n_estimators": (2, 4), "max_depth": (None, 2), "min_samples_split": (2, 60), "min_samples_leaf": (1, 5)}
    found = tuning.grid_search(data, "id", FEATURES, "y", grid, folds=2)
    assert len(found) == 16 and len({tuple(sorted(r["params"].items(), key=str)) for r in found}) == 16
    assert [r["mean_score"] for r in found] == sorted((r["mean_score"] for r in found), reverse=True)
    # The full forest of a leaf size, fitted and scored the plain way.
    (deep,) = [r for r in found if r["params"] == {"n_estimators": 4, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1}]
    with fit_input(tuning._prepared(data, "id", FEATURES, "y", 2, 42), "id") as kept:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(kept)
        plain = []
        for fold in (0, 1):
            model = forest("y", 4, None, 42).fit(rows.filter(F.col("fold") != fold))
            plain.append(regression.regression_metrics(model.transform(rows.filter(F.col("fold") == fold)), "y", "prediction").first().r2)
    assert deep["mean_score"] == pytest.approx(np.mean(plain)) and deep["std_score"] == pytest.approx(np.std(plain))
    table = tuning.search_table(data, found)
    assert table.count() == 16 and "min_samples_split" in table.columns


def test_parzen_search_beats_even_draws():
    ranges = {"a": (0, 60), "b": (0, 60), "c": (1, 9)}
    loss = lambda p: (p["a"] - 44) ** 2 + 2 * (p["b"] - 13) ** 2 + 30 * abs(p["c"] - 4)
    ours, even = [], []
    for seed in range(12):
        trials = parzen.minimise(lambda points: [loss(p) for p in points], ranges, calls=50, seed=seed)
        assert len(trials) == 50 and all(lo <= p[n] <= hi for p, _ in trials for n, (lo, hi) in ranges.items())
        rng = random.Random(seed + 100)
        ours.append(min(score for _, score in trials))
        even.append(min(loss({n: rng.randint(*r) for n, r in ranges.items()}) for _ in range(50)))
    assert np.median(ours) < 0.6 * np.median(even)
    few = parzen.minimise(lambda points: [p["a"] for p in points], {"a": (0, 3)}, calls=50)
    assert sorted(p["a"] for p, _ in few) == [0, 1, 2, 3]


def test_adaptive_search_scores_new_points_only(data):
    ranges = {"n_estimators": (2, 4), "max_depth": (2, 4), "min_samples_split": (2, 3), "min_samples_leaf": (1, 2)}
    found = tuning.adaptive_search(data, "id", FEATURES, "y", ranges, calls=6, first=3, folds=2)
    marks = [tuple(sorted(r["params"].items())) for r in found]
    assert len(marks) == len(set(marks)) == 6 and found[0]["mean_score"] == min(r["mean_score"] for r in found)


def test_param_rules(spark):
    params = spark.createDataFrame(
        [(10, 3, 2), (0, 3, 2), (10, 1, 3), (10, None, 99)], "n_estimators int, max_depth int, min_samples_split int"
    )
    assert [r.problem for r in regression.param_checks(params).collect()] == [
        None,
        "n_estimators",
        "split_exceeds_depth",
        None,
    ]


def test_metric_rules(spark):
    table = spark.createDataFrame([(0.8, 1.0, 1.0), (0.5, 1.0, 2.0)], "r2 double, rmse double, mse double")
    got = [(r.rmse_consistent, r.good) for r in regression.metric_checks(table).collect()]
    assert got == [(True, True), (False, False)]
    by_error = spark.createDataFrame([(0.2,), (0.4,)], "rmse double")
    assert [r.good for r in regression.metric_checks(by_error).collect()] == [True, False]
    f1 = spark.createDataFrame([(0.5, 0.5, 0.5), (0.5, 0.5, 0.9)], "precision double, recall double, f1 double")
    assert [r.f1_consistent for r in regression.metric_checks(f1).collect()] == [True, False]


def test_generated_features(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "x double, z double")
    row = features.polynomial_features(df, degree=2, bias=True).first().asDict()
    assert row == {"x": 2.0, "z": 3.0, "1": 1.0, "x^2": 4.0, "x z": 6.0, "z^2": 9.0}
    assert features.interaction_features(df).first().asDict() == {"x": 2.0, "z": 3.0, "x_x_z": 6.0}


def test_mutual_information_of_a_copy_and_of_noise(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), float(v), float(n)) for v, n in zip(rng.normal(size=2000), rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "y double, same double, noise double")
    got = {r.feature: r.score for r in features.mutual_information(df, ["same", "noise"], "y").collect()}
    assert got["same"] == pytest.approx(np.log(10), abs=0.01) and got["noise"] < 0.05


def test_pca_matches_numpy(data):
    pandas = data.toPandas()
    x = pandas[FEATURES].to_numpy()
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    got = features.pca(data, "id", FEATURES, components=2).orderBy("id").toPandas()
    want = centred @ vt[:2].T
    for i in range(2):
        assert np.abs(got[f"PC{i + 1}"]) .to_numpy() == pytest.approx(np.abs(want[:, i]), abs=1e-8)
    share = np.cumsum(s**2 / (s**2).sum())
    assert len(features.pca(data, "id", FEATURES).columns) - 1 == int(np.argmax(share >= 0.95)) + 1


def blobs(spark):
    rng = np.random.default_rng(5)
    centres = [(0, 0), (8, 0), (0, 8)]
    rows = [(i, *map(float, rng.normal(centres[i % 3], 1)), i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "id int, p double, q double, g int")


def test_separation_matches_brute_force(spark):
    df = blobs(spark)
    pandas = df.toPandas()
    x, g = pandas[["p", "q"]].to_numpy(), pandas.g.to_numpy()
    centres = np.array([x[g == k].mean(0) for k in range(3)])
    scatter = [np.linalg.norm(x[g == k] - centres[k], axis=1).mean() for k in range(3)]
    db = np.mean(
        [
            max((scatter[i] + scatter[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i)
            for i in range(3)
        ]
    )
    between = sum((g == k).sum() * ((centres[k] - x.mean(0)) ** 2).sum() for k in range(3))
    inside = sum(((x[g == k] - centres[k]) ** 2).sum() for k in range(3))
    row = clusters.separation(df, ["p", "q"], "g").first()
    assert row.davies_bouldin == pytest.approx(db)
    assert row.calinski_harabasz == pytest.approx(between / 2 / (inside / 297))
    single = clusters.separation(df.withColumn("g", F.lit(0)), ["p", "q"], "g").first()
    assert (single.davies_bouldin, single.calinski_harabasz) == (0.0, 0.0)
    assert clusters.silhouette(df, ["p", "q"], "g") > 0.7


def test_three_blobs_are_found(spark):
    df = blobs(spark)
    chosen, curve = clusters.find_k(df, ["p", "q"], k_max=6, starts=3, max_iter=20)
    assert chosen == 3 and [k for k, _ in curve] == [2, 3, 4, 5, 6]
    assigned = clusters.assign_clusters(df, "id", ["p", "q"], 3)
    assert sorted(r["size"] for r in clusters.cluster_profile(assigned, ["p", "q"]).collect()) == [100, 100, 100]


def test_knee():
    assert clusters.knee([(2, 100), (3, 30), (4, 25), (5, 22), (6, 20)]) == 3
    assert clusters.knee([(2, 100), (3, 75), (4, 50), (5, 25), (6, 0)]) is None


def test_qq_line_of_normal_values(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(3, 2, 5000)], "residual double")
    row = charts.qq_points(df).first()
    assert row.slope == pytest.approx(2, abs=0.1) and row.intercept == pytest.approx(3, abs=0.1)


def test_histogram_counts_every_kept_value(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    table = charts.histogram(df, "x", cap_percentile=None)
    assert table.count() == 30 and table.agg(F.sum("n")).first()[0] == 1000
    flat = charts.histogram(df.select(F.lit(4.0).alias("x")), "x", cap_percentile=None).filter("n > 0").first()
    assert flat.n == 1000 and flat.bin_low <= 4.0 <= flat.bin_high


def test_batched_runs_are_single_runs(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.6, (80, 2)) for c in ([0, 0], [6, 1], [2, 7])])
    x = np.concatenate([x, x[:40], x[:40]])  # equal rows count as often as they occur
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "p double, q double")
    wanted = [(k, seed) for k in (1, 2, 3, 5) for seed in range(4)]
    runs = lloyd.batched_kmeans(df.repartition(5), ["p", "q"], wanted)
    again = lloyd.batched_kmeans(df.coalesce(1), ["p", "q"], wanted)
    assert [(r.k, r.seed) for r in runs] == wanted and np.allclose([r.cost for r in runs], [r.cost for r in again])
    started = lloyd.batched_kmeans(df, ["p", "q"], wanted, max_iter=0)
    for run, start in zip(runs, started):
        centres = start.centres
        assert len(np.unique(centres, axis=0)) == run.k
        for _ in range(run.passes):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(run.k)])
        assert np.allclose(centres, run.centres) and run.rests
        assert run.cost == pytest.approx(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum())
    assert min(r.cost for r in runs if r.k == 3) < 0.2 * min(r.cost for r in runs if r.k == 2)
    assert [len(r.centres) for r in lloyd.batched_kmeans(df.limit(1), ["p", "q"], [(3, 1)])] == [3]
    with pytest.raises(ValueError):
        lloyd.batched_kmeans(df.limit(0), ["p", "q"], [(2, 1)])


def test_composed_models_predict_alike_after_storing(spark, data, tmp_path):
    def line():
        return regression.make_regressor("linear_regression", "y")

    rows = regression.mark_folds(data, "id")
    nested = VotingRegressor({"line": line(), "boost": AdaBoostR2("y", rounds=3)})
    kinds = {
        "adaboost": AdaBoostR2("y", rounds=4),
        "voting of models of models": VotingRegressor({"inner": nested, "tree": regression.make_regressor("decision_tree", "y")}),
        "stacking": StackingRegressor({"line": line(), "boost": AdaBoostR2("y", rounds=2)}, "y", folds=2, trees=5),
    }
    for name, estimator in kinds.items():
        model = regression.scaled_pipeline(FEATURES, estimator).fit(rows)
        path = str(tmp_path / name.replace(" ", "_"))
        for _ in range(2):  # the second time replaces the first
            stored = sinks.load_model(spark, sinks.save_model(model, path))
        before = model.transform(rows).select("id", *FEATURES, F.col("prediction").alias("before"))
        assert stored.transform(before).filter("before <> prediction or prediction is null").count() == 0
        assert [s.uid for s in stored.stages] == [s.uid for s in model.stages]
        bare = sinks.load_model(spark, sinks.save_model(model.stages[-1], path + "_bare"))
        assert type(bare) is type(model.stages[-1])


def test_copies_of_composed_models_are_apart(data):
    model = regression.scaled_pipeline(FEATURES, AdaBoostR2("y", rounds=2)).fit(data).stages[-1]
    copied = model.copy()
    copied.trees[0].setPredictionCol("elsewhere")
    assert model.trees[0].getPredictionCol() != "elsewhere" and copied.weights == model.weights
    assert copied.uid == model.uid


def test_moments_give_the_folds_of_fitted_models(data):
    names = ["linear_regression", "ridge", "lasso"]
    slow = {r.model: r for r in tuning.compare_models(data, "id", FEATURES, "y", names, folds=2).collect()}
    fast = {r.model: r for r in linear_folds.compare_linear(data, "id", FEATURES, "y", [*names, "unknown"], folds=2).collect()}
    for name in names:
        for field in ("cv_mean", "cv_std", "r2", "rmse"):
            assert fast[name][field] == pytest.approx(slow[name][field], abs=1e-4), (name, field)
        assert fast[name].best == slow[name].best and fast[name].error is None
    assert fast["unknown"].error is not None


def test_moments_give_the_learning_curve_of_fitted_models(data):
    line = regression.make_regressor("linear_regression", "y")
    slow = tuning.learning_curve(data, "id", FEATURES, "y", line, (0.5, 1.0), folds=2).collect()
    fast = linear_folds.linear_learning_curve(data, "id", FEATURES, "y", fractions=(0.5, 1.0), folds=2).collect()
    for a, b in zip(slow, fast, strict=True):
        assert tuple(b) == pytest.approx(tuple(a), abs=1e-6)


def test_moments_of_odd_tables(spark):
    rng = np.random.default_rng(9)
    x = 1e9 + rng.normal(0, 1, 200)  # far from zero
    rows = [(i, float(v), 5.0, float(v), float(2 * v + e)) for i, (v, e) in enumerate(zip(x, rng.normal(0, 0.1, 200)))]
    df = spark.createDataFrame([*rows, (None, None, None, None, None)], "id int, a double, k double, b double, y double")
    found = linear_folds.compare_linear(df, "id", ["a", "k", "b"], "y", folds=3)  # one constant feature, one twice
    assert all(r.error is None and r.r2 > 0.6 for r in found.collect())
    assert found.filter("model = 'linear_regression'").first().r2 > 0.99
    empty = df.limit(0)
    assert all(r.cv_mean is None or np.isnan(r.cv_mean) for r in linear_folds.compare_linear(empty, "id", ["a"], "y").collect())
    curve = linear_folds.linear_learning_curve(empty, "id", ["a"], "y", fractions=(1.0,)).collect()
    assert curve[0].train_rows == 0 and np.isnan(curve[0].valid_mean)


def test_wide_moments_come_in_several_passes(data, monkeypatch):
    whole = linear_folds.moment_table(data, [*FEATURES, "y"], [F.lit(0)])
    monkeypatch.setattr(linear_folds, "PAIRS_PER_PASS", 3)
    parts = linear_folds.moment_table(data, [*FEATURES, "y"], [F.lit(0)])
    values = data.select(*FEATURES, "y").toPandas().to_numpy()
    assert np.allclose(whole[0,].spread, parts[0,].spread, rtol=1e-12)
    assert np.allclose(whole[0,].spread, np.cov(values.T, bias=True) * 400)
