import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from weirworks.operators import features, lloyd, merged, regression, tuning
from weirworks.operators.ensembles import AdaBoostR2
from weirworks.operators.forests import ForestModel, GrownBoost, GrownTree, forest
from weirworks.operators.growth import BINS, Cut, Forest, borders, weighted_median
from weirworks.sources import sinks

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(0, 1, 300), rng.integers(0, 6, 300), rng.integers(-40, 40, 300)]).astype(float)
    y = x[:, 0] * 2 + x[:, 1] + (x[:, 2] > 0) * 3 + rng.normal(0, 0.5, 300)
    table = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    table += [(300 + i, *r[1:]) for i, r in enumerate(table[:60])]  # some rows come twice
    frame = spark.createDataFrame(table, "id int, a double, b double, c double, y double")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame).cache()


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").select("prediction").collect()])


def test_merged_trees_are_those_of_spark(rows):
    for estimator in (GrownTree("y"), GrownTree("y", depth=4), GrownBoost("y", rounds=8)):
        assert np.allclose(predicted(estimator.fit(rows), rows), predicted(estimator._distributed().fit(rows), rows))
    boost = AdaBoostR2("y", rounds=6)
    ours, spread = boost.fit(rows), boost._spread(rows)
    assert ours.weights == pytest.approx(spread.weights) and np.allclose(predicted(ours, rows), predicted(spread, rows))


def test_borders_share_the_weight():
    assert borders(np.array([1.0, 2.0, 5.0]), np.array([1.0, 0.0, 3.0])).tolist() == [3.0]
    values = np.arange(1000.0)
    assert len(borders(values, np.ones(1000))) == BINS - 1
    assert borders(values, np.where(values < 10, 1000.0, 1.0))[:9].tolist() == [v + 0.5 for v in range(9)]


def test_forests_depend_on_the_rows_only(rows):
    one = forest("y", 6, seed=3).fit(rows.coalesce(1))
    many = forest("y", 6, seed=3).fit(rows.repartition(7))
    assert np.array_equal(predicted(one, rows), predicted(many, rows))
    assert not np.allclose(predicted(one, rows), predicted(forest("y", 6, seed=4).fit(rows), rows))
    # As good as Spark's own, whose bags are other draws.
    score = lambda model: regression.regression_metrics(model.transform(rows), "y", "prediction").first().r2
    assert score(forest("y", 30).fit(rows)) == pytest.approx(score(forest("y", 30)._distributed().fit(rows)), abs=0.02)


def test_bags_hold_each_copy(rows):
    data = merged.merge_rows(rows, F.array(*FEATURES), F.col("y"))
    assert sorted(data.counts.tolist()) == [1.0] * 240 + [2.0] * 60
    plan = Forest(40, 30, 1, 1)
    held = [tree.weight[0] for tree in plan.grown(data.binned(None), data.counts, data.y, 0, 40)]
    assert np.mean(held) == pytest.approx(360, rel=0.05) and np.std(held) > 5


def test_scores_are_those_of_fitted_models(spark, rows):
    folded = regression.mark_folds(rows, "id", 3)
    data = merged.merge_rows(folded, F.array(*FEATURES), F.col("y"), F.col("fold"))
    kinds = [forest("y", 23, 6, min_leaf=2), GrownTree("y"), GrownBoost("y", rounds=5), AdaBoostR2("y", rounds=5)]
    for kind in kinds:
        for fold in (1, None):
            (found,) = merged.error_sums(spark, data, [merged.Fit(kind.recipe(), fold)])
            model = kind.fit(folded if fold is None else folded.filter("fold <> 1"))
            plain = regression.regression_metrics(model.transform(folded if fold is None else folded.filter("fold = 1")), "y", "prediction").first()
            for metric in ("r2", "rmse", "mae", "mse", "n"):
                assert found[0, True][metric] == pytest.approx(plain[metric]), (kind, fold, metric)


def test_cuts_are_smaller_forests(spark, rows):
    data = merged.merge_rows(rows, F.array(*FEATURES), F.col("y"))
    cuts = (Cut(25, 30), Cut(12, 3), Cut(7, 30))
    (found,) = merged.error_sums(spark, data, [merged.Fit(Forest(25, 30, 1, 42, cuts))])
    for i, cut in enumerate(cuts):
        plain = regression.regression_metrics(forest("y", cut.trees, cut.depth).fit(rows).transform(rows), "y", "prediction").first()
        assert found[i, True]["mse"] == pytest.approx(plain.mse)


def test_importances_need_no_model(rows):
    estimator = forest("y", 12)
    model = estimator.fit(rows)
    assert isinstance(model, ForestModel)
    assert estimator.importances(rows) == pytest.approx(model.featureImportances.toArray().tolist())
    table = features.importance_table(rows.drop("features"), FEATURES, "y", trees=12)
    assert {r.feature: r.importance for r in table.collect()} == pytest.approx(dict(zip(FEATURES, estimator.importances(rows))))


def test_stored_forests_predict_alike(spark, rows, tmp_path):
    model = forest("y", 11).fit(rows)
    path = sinks.save_model(model, str(tmp_path / "forest"))
    stored = sinks.load_model(spark, path)
    sinks.save_model(stored, path)  # over the place it was read from
    for found in (stored, sinks.load_model(spark, path), model.copy()):
        assert np.array_equal(predicted(found, rows), predicted(model, rows))
    assert len(stored.trees) == 11 and sum(t.numNodes for t in stored.trees) == stored.totalNumNodes


def test_many_different_rows_are_left_to_spark(rows, monkeypatch):
    monkeypatch.setattr(merged, "MERGED_NUMBERS", 100)
    assert merged.merge_rows(rows, F.array(*FEATURES), F.col("y")) is None
    assert len(forest("y", 3, 3).importances(rows)) == 3
    plain = rows.drop("features")
    assert tuning.cross_validate(plain, "id", FEATURES, "y", forest("y", 3, 3), folds=2).count() == 6
    found = tuning.compare_models(plain, "id", FEATURES, "y", ["decision_tree"], folds=2).first()
    assert found.error is None and found.best


def test_odd_rows_are_refused(spark, rows):
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            merged.merge_rows(rows.withColumn("y", F.when(F.col("id") != 5, F.col("y")).otherwise(F.lit(bad))), F.array(*FEATURES), F.col("y"))
    with pytest.raises(ValueError):
        merged.merge_rows(rows.limit(0), F.array(*FEATURES), F.col("y"))
    one = forest("y", 3).fit(rows.limit(1))
    assert np.allclose(predicted(one, rows), rows.first().y)


def test_weighted_median_by_hand():
    assert weighted_median(np.array([[1.0, 2.0], [9.0, 0.0], [5.0, 1.0]]), np.array([1.0, 1.0, 3.0])).tolist() == [5.0, 1.0]


def test_runs_in_tasks_are_those_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.8, (60, 3)) for c in ([0, 0, 1], [5, 1, 0], [2, 6, 3])])
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.concatenate([x, x[:30]])], "p double, q double, r double")
    wanted = [(k, seed) for k in (1, 2, 4) for seed in range(3)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("held", "held")
    ours = lloyd.batched_kmeans(df, ["p", "q", "r"], wanted)
    assert len(jobs.getJobIdsForGroup("held")) < 10  # not one for each pass
    spark.sparkContext.setJobGroup("passes", "passes")
    monkeypatch.setattr(lloyd, "HELD_NUMBERS", 0)
    passes = lloyd.batched_kmeans(df, ["p", "q", "r"], wanted)
    for a, b in zip(ours, passes, strict=True):
        assert np.allclose(a.centres, b.centres) and a.cost == pytest.approx(b.cost)
        assert (a.k, a.seed, a.rests, a.passes) == (b.k, b.seed, b.rests, b.passes)
