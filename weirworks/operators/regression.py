"""Splits, scaling, regression models, scoring and checks on metrics and parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import all_present, quoted
from weirworks.operators.ensembles import AdaBoostR2
from weirworks.operators.forests import MAX_DEPTH, GrownBoost, GrownTree, forest
from weirworks.operators.rules import require_input
from weirworks.session import ROWS_PER_TASK, fit_input

# The regressors of a comparison, in their usual order.
MODEL_NAMES = (
    "random_forest",
    "gradient_boosting",
    "adaboost",
    "linear_regression",
    "ridge",
    "lasso",
    "decision_tree",
)


def hash_bucket(key: str, buckets: int, seed: int = 42) -> Column:
    """A number below ``buckets`` that depends on the key only, not on partitions or order."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit("")))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def mark_split(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``, true for about ``train_share`` of the keys."""
    return df.withColumn("is_train", hash_bucket(key, 10000, seed) < int(train_share * 10000))


def mark_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from 0 to folds - 1."""
    return df.withColumn("fold", hash_bucket(key, folds, seed))


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and divide by the population deviation; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()  # one row
    kept = [quoted(c) for c in df.columns if c not in columns]
    scaled = [
        ((quoted(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)).cast("double").alias(c)
        for i, c in enumerate(columns)
    ]
    return df.select(*kept, *scaled)


class PopulationScaler(Estimator):
    """Centres vectors and divides by the population deviation (``StandardScaler`` uses the sample one)."""

    def __init__(self, input_col: str, output_col: str):
        super().__init__()
        self.input_col, self.output_col = input_col, output_col

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        scaler = StandardScaler(inputCol=self.input_col, outputCol="_sample_scaled", withMean=True, withStd=True)
        n = dataset.count()
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        fitted = scaler.fit(dataset)
        stretch = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * fitted.mean.size), inputCol="_sample_scaled", outputCol=self.output_col
        )
        return PipelineModel([fitted, stretch])


class RidgeRegression(Estimator):
    """Least squares with a penalty of ``alpha`` times the squared coefficients on the summed squared error."""

    def __init__(self, label_col: str, features_col: str = "features", alpha: float = 1.0):
        super().__init__()
        self.label_col, self.features_col, self.alpha = label_col, features_col, alpha

    def _fit(self, dataset: DataFrame) -> Model:
        stats = dataset.agg(F.count("*").alias("n"), F.stddev_pop(quoted(self.label_col)).alias("s")).first()
        return LinearRegression(
            labelCol=self.label_col,
            featuresCol=self.features_col,
            solver="normal",
            elasticNetParam=0.0,
            standardization=False,
            regParam=self.alpha * stats["s"] / stats["n"],
        ).fit(dataset)


def make_regressor(name: str, target: str, trees: int = 100, seed: int = 42, max_depth: int | None = None) -> Estimator:
    """One regressor of the comparison by name."""
    common = {"labelCol": target, "featuresCol": "features"}
    if name == "random_forest":
        return forest(target, trees, max_depth, seed)
    if name == "gradient_boosting":
        return GrownBoost(target, rounds=trees, depth=3, step=0.1, seed=seed)
    if name == "adaboost":
        return AdaBoostR2(target, rounds=trees, seed=seed)
    if name == "linear_regression":
        return LinearRegression(**common, regParam=0.0, solver="normal")
    if name == "ridge":
        return RidgeRegression(target)
    if name == "lasso":
        return LinearRegression(**common, regParam=1.0, elasticNetParam=1.0, standardization=False, solver="l-bfgs")
    if name == "decision_tree":
        return GrownTree(target, depth=MAX_DEPTH, seed=seed)
    raise ValueError(f"unknown model {name}; known: {', '.join(MODEL_NAMES)}")


def scaled_pipeline(features: Sequence[str], regressor: Estimator) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw_features"),
            PopulationScaler("raw_features", "features"),
            regressor,
        ]
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """(r2, rmse, mae, mse, n) over the rows with both values, per group if keys are given."""
    a, p = quoted(actual), quoted(predicted)
    pairs = df.filter(all_present([actual, predicted]))
    mse = F.avg(F.pow(a - p, 2))
    variance = F.var_pop(a)
    return pairs.groupBy(*map(quoted, keys)).agg(
        F.when(variance > 0, F.lit(1.0) - mse / variance).alias("r2"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
        mse.alias("mse"),
        F.count("*").alias("n"),
    )


def metric_checks(metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds consistency flags, the primary metric and whether it is good enough.

    Works on whichever of r2, accuracy, f1, precision, recall, rmse, mse and mae the table has; the primary metric is
    the first present of r2, accuracy, f1, rmse. Higher is better except for rmse, which must be at most 1 - threshold.
    """
    have = set(metrics.columns)

    def value(name: str) -> Column:
        return quoted(name).cast("double") if name in have else F.lit(None).cast("double")

    f1 = 2 * value("precision") * value("recall") / (value("precision") + value("recall"))
    comparable = (value("precision") > 0) & (value("recall") > 0)
    higher = F.coalesce(value("r2"), value("accuracy"), value("f1"))
    in_bounds = F.lit(True)
    for name in ("r2", "accuracy", "f1", "precision", "recall"):
        in_bounds = in_bounds & F.coalesce(value(name) <= 1, F.lit(True))
    for name in ("accuracy", "f1", "precision", "recall", "rmse", "mse", "mae"):
        in_bounds = in_bounds & F.coalesce(value(name) >= 0, F.lit(True))
    return metrics.withColumns(
        {
            "rmse_consistent": F.coalesce(F.abs(value("rmse") - F.sqrt(value("mse"))) <= 1e-6, F.lit(True)),
            "f1_consistent": F.coalesce(~comparable | (F.abs(value("f1") - f1) <= 0.01), F.lit(True)),
            "in_bounds": in_bounds,
            "primary_metric": F.coalesce(higher, value("rmse")),
            "good": F.coalesce(higher >= threshold, value("rmse") <= 1.0 - threshold, F.lit(False)),
        }
    )


def param_checks(params: DataFrame) -> DataFrame:
    """Adds ``problem``, the first rule a row of parameters breaks, or missing.

    Looks at n_estimators, max_depth, min_samples_split, min_samples_leaf, learning_rate, alpha, l1_ratio, random_state
    and test_size, each optional.
    """
    have = set(params.columns)
    rules: list[tuple[str, str, Column]] = []
    for name, fails in (
        ("n_estimators", lambda v: v <= 0),
        ("max_depth", lambda v: v <= 0),
        ("min_samples_split", lambda v: v < 2),
        ("min_samples_leaf", lambda v: v < 1),
        ("learning_rate", lambda v: (v <= 0) | (v > 1)),
        ("alpha", lambda v: v < 0),
        ("l1_ratio", lambda v: (v < 0) | (v > 1)),
        ("random_state", lambda v: v < 0),
        ("test_size", lambda v: (v <= 0) | (v >= 1)),
    ):
        if name in have:
            rules.append((name, name, fails(quoted(name))))
    if {"max_depth", "min_samples_split"} <= have:
        too_wide = quoted("min_samples_split") > F.pow(F.lit(2.0), quoted("max_depth"))
        rules.append(("split", "split_exceeds_depth", too_wide))
    if not rules:
        return params.withColumn("problem", F.lit(None).cast("string"))
    return params.withColumn("problem", F.coalesce(*[F.when(fails, F.lit(problem)) for _, problem, fails in rules]))


def train_regressor(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    model: str = "random_forest",
    trees: int = 100,
    train_share: float = 0.8,
    seed: int = 42,
    min_rows: int = 10,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training part and measure on the rest; (model, metrics).

    Trees grown by Spark, from too many different rows to merge, bag by task and so depend on ``rows_per_task``, but not on the cluster.
    """
    complete = require_input(df, [*features, target], min_rows, drop_incomplete=False)
    marked = mark_split(complete.select(quoted(key), *map(quoted, [*features, target])), key, train_share, seed)
    regressor = make_regressor(model, target, trees, seed)
    if isinstance(regressor, (GrownBoost, GrownTree)):  # one fit is quick enough, and Spark breaks ties of equal gains its own way
        regressor = regressor._distributed()
    with fit_input(marked.filter("is_train"), key, rows_per_task) as training:
        fitted = scaled_pipeline(features, regressor).fit(training)
    held_out = fitted.transform(marked.filter(~F.col("is_train")))
    return fitted, regression_metrics(held_out, target, "prediction")


def batch_predict(model: Model, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, prediction) for every row; incomplete rows keep their key and get no prediction."""
    filled = df.select(
        quoted(key),
        all_present(features).alias("_complete"),
        *[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
    )
    scored = model.transform(filled)
    usable = F.col("_complete") & ~F.isnan("prediction")
    return scored.select(quoted(key), F.when(usable, F.col("prediction")).alias("prediction"))


def linear_terms(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(term, value): intercept and coefficients of a fitted linear pipeline in the units of the raw features."""
    scaler, regressor = model.stages[1], model.stages[-1]
    means, deviations = scaler.stages[0].mean.toArray(), scaler.stages[0].std.toArray()
    factor = scaler.stages[1].getScalingVec().toArray()
    slopes = [
        float(w) * float(f) / float(s) if s else 0.0
        for w, f, s in zip(regressor.coefficients.toArray(), factor, deviations)
    ]
    intercept = float(regressor.intercept) - sum(b * float(m) for b, m in zip(slopes, means))
    rows = [("intercept", intercept), *zip(features, slopes)]
    return df.sparkSession.createDataFrame(rows, "term string, value double")
