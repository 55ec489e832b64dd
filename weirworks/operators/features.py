"""Generated features and feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.ml import Estimator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import long_rows, numeric_names, quoted
from weirworks.operators.forests import GrownForest, forest
from weirworks.operators.quantiles import quantile_values
from weirworks.session import reused


def interaction_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Products of all pairs, named ``a_x_b``."""
    columns = numeric_names(df) if columns is None else columns
    return df.withColumns({f"{a}_x_{b}": quoted(a) * quoted(b) for a, b in combinations(columns, 2)})


def _monomial(columns: Sequence[str], powers: Sequence[int]) -> tuple[str, Column]:
    """Name and product of one monomial, e.g. ``a^2 b``."""
    used = [(c, p) for c, p in zip(columns, powers) if p]
    name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in used)
    factors = [quoted(c).cast("double") for c, p in used for _ in range(p)]
    product = factors[0]
    for factor in factors[1:]:
        product = product * factor
    return name, product


def polynomial_features(
    df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2, bias: bool = False
) -> DataFrame:
    """All monomials of degree 2 up to ``degree`` next to the originals; the bias is a column named ``1``."""
    columns = numeric_names(df) if columns is None else list(columns)
    made: dict[str, Column] = {"1": F.lit(1.0)} if bias else {}
    for total in range(2, degree + 1):
        for picked in combinations_with_replacement(range(len(columns)), total):
            name, product = _monomial(columns, [picked.count(i) for i in range(len(columns))])
            made[name] = product
    return df.withColumns(made)


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r, score): F statistic of a one-feature linear fit, all features in one pass."""
    single = df.agg(
        F.count(quoted(target)).alias("n"),
        *[F.corr(quoted(c).cast("double"), quoted(target).cast("double")).alias(f"r{i}") for i, c in enumerate(features)],
    )
    rows = []
    for i, c in enumerate(features):
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        score = F.when(r2 < 1, r2 / (F.lit(1.0) - r2) * (F.col("n") - 2)).when(r2 >= 1, F.lit(float("inf")))
        rows.append({"feature": F.lit(c), "r": F.col(f"r{i}"), "score": score})
    return long_rows(single, rows)


def _bin_of(value: Column, edges: Sequence[float]) -> Column:
    inside = F.lit(0)
    for edge in sorted(set(edges)):
        inside = inside + (value > F.lit(edge)).cast("int")
    return inside


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, score): mutual information in nats between quantile bins of feature and target.

    One grouping by (feature, bin, bin) gives at most features x bins x bins rows; the rest works on those.
    """
    probs = [i / bins for i in range(1, bins)]
    edges = quantile_values(df, [*features, target], probs)
    pairs = [
        F.struct(F.lit(c).alias("feature"), _bin_of(quoted(c), edges.get(c, [])).alias("x")) for c in features
    ]
    cells = (
        df.select(_bin_of(quoted(target), edges.get(target, [])).alias("y"), F.inline(F.array(*pairs)))
        .groupBy("feature", "x", "y")
        .agg(F.count("*").alias("n"))
    )
    xs = cells.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ys = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    totals = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    joined = cells.join(xs, ["feature", "x"]).join(ys, ["feature", "y"]).join(totals, "feature")
    n, total = F.col("n").cast("double"), F.col("total")
    term = n / total * F.log(n * total / (F.col("nx").cast("double") * F.col("ny")))
    return joined.groupBy("feature").agg(F.sum(term).alias("score"))


def select_best(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores; equal scores in name order."""
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def assembled(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


def _importances(estimator: Estimator, df: DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, weight) of an estimator's model of ``df``: split importances, or absolute coefficients."""
    rows = assembled(df, features)
    if isinstance(estimator, GrownForest):
        return list(zip(features, estimator.importances(rows)))
    model = estimator.fit(rows)
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return [(c, abs(float(w))) for c, w in zip(features, weights.toArray())]


def importance_table(
    df: DataFrame, features: Sequence[str], target: str, estimator: Estimator | None = None, trees: int = 100, seed: int = 42
) -> DataFrame:
    """(feature, importance) of one fitted model, one row per feature."""
    weights = _importances(estimator or forest(target, trees, seed=seed), df, features)
    return df.sparkSession.createDataFrame(weights, "feature string, importance double")


def select_importance(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    threshold: float | None = None,
    max_features: int | None = None,
    estimator: Estimator | None = None,
    trees: int = 100,
    seed: int = 42,
) -> DataFrame:
    """(feature, importance, selected): at or above a threshold, the k-th largest importance, or the median."""
    weights = _importances(estimator or forest(target, trees, seed=seed), df, features)
    ordered = sorted((w for _, w in weights), reverse=True)
    if threshold is None and max_features is not None:
        threshold = ordered[min(max_features, len(ordered)) - 1]
    elif threshold is None:
        middle = len(ordered) // 2
        threshold = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    rows = [(c, w, w >= threshold) for c, w in weights]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, selected boolean")


def select_rfe(
    df: DataFrame, features: Sequence[str], target: str, keep: int, trees: int = 50, seed: int = 42
) -> DataFrame:
    """(feature, rank, selected): drop the least important feature, fit again, until ``keep`` are left."""
    remaining, dropped = list(features), []
    with reused(df.select(*map(quoted, [*features, target]))) as data:
        while len(remaining) > keep:
            found = _importances(forest(target, trees, seed=seed), data, remaining)
            worst = min(found, key=lambda pair: pair[1])[0]
            remaining.remove(worst)
            dropped.append(worst)
    rows = [(c, 1, True) for c in remaining] + [(c, len(dropped) - i + 1, False) for i, c in enumerate(dropped)]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean")


def pca(
    df: DataFrame, key: str, features: Sequence[str], components: int | None = None, variance: float = 0.95
) -> DataFrame:
    """Key and PC1..PCk of the centred features; k is given or the fewest that explain ``variance``."""
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False)
    raw = assembled(df.select(quoted(key), *map(quoted, features)), features, "raw")
    with reused(raw.select(quoted(key), "raw")) as data:
        centred = scaler.fit(data).transform(data)
        model = PCA(k=components or len(features), inputCol="features", outputCol="pc").fit(centred)
        if components is None:
            covered, components = 0.0, len(features)
            for i, share in enumerate(model.explainedVariance.toArray()):
                covered += float(share)
                if covered >= variance:
                    components = i + 1
                    break
    scores = model.transform(scaler.fit(raw).transform(raw)).select(quoted(key), vector_to_array("pc").alias("pc"))
    return scores.select(quoted(key), *[F.get("pc", F.lit(i)).alias(f"PC{i + 1}") for i in range(components)])
