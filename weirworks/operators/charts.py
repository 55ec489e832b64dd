"""The tables behind the charts."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import all_present, quoted
from weirworks.operators.profile import missing_profile
from weirworks.operators.regression import hash_bucket
from weirworks.operators.quantiles import exact_quantiles, quantile_values
from weirworks.operators.groups import top_groups


def _bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, bin_low, bin_high, n, share, mean): equal-width bins, the last one closed; empty bins are kept.

    A first pass fetches the range as one row; ``share`` is the part of the values, ``mean`` their mean.
    """
    values = df.select(quoted(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.avg("x").alias("m")).first()
    if not ends["n"]:
        shape = "bin bigint, bin_low double, bin_high double, n bigint, share double, mean double"
        return df.sparkSession.createDataFrame([], shape)
    widen = 0.5 if ends["lo"] == ends["hi"] else 0.0
    low, high = ends["lo"] - widen, ends["hi"] + widen
    place = F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * bins)
    counted = (
        values.select(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    edges = df.sparkSession.range(0, bins, 1, 1).select(F.col("id").alias("bin"))
    width = F.lit((high - low) / bins)
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return edges.join(F.broadcast(counted), "bin", "left").select(  # at most one row per bin
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("bin_low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_high"),
        n.alias("n"),
        (n / F.lit(ends["n"])).alias("share"),
        F.lit(ends["m"]).alias("mean"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30, cap_percentile: float | None = 99.0) -> DataFrame:
    """Histogram up to a percentile, with mean and median of the uncapped column for the marker lines."""
    probs = [0.5] if cap_percentile is None else [0.5, cap_percentile / 100.0]
    found = quantile_values(df, [column], probs).get(column, [None] * len(probs))
    kept = df if cap_percentile is None else df.filter(quoted(column) <= F.lit(found[1]).cast("double"))
    mean = df.agg(F.avg(quoted(column)).alias("m")).first()["m"]
    return _bins(kept, column, bins).select(
        "bin",
        "bin_low",
        "bin_high",
        "n",
        F.lit(mean).cast("double").alias("mean"),
        F.lit(found[0]).cast("double").alias("median"),
    )


def density_shift(before: DataFrame, after: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(dataset, bin, bin_low, bin_high, density) of both frames, each over its own range."""
    parts = []
    for name, df in (("raw", before), ("cleaned", after)):
        density = F.col("share") / (F.col("bin_high") - F.col("bin_low"))
        parts.append(_bins(df, column, bins).select(F.lit(name).alias("dataset"), "bin", "bin_low", "bin_high", density.alias("density")))
    return parts[0].unionByName(parts[1])


def geo_footprint(before: DataFrame, after: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """(dataset, x_cell, y_cell, n): rows with both coordinates counted on a grid."""
    parts = []
    for name, df in (("raw", before), ("cleaned", after)):
        cells = df.filter(all_present([x, y])).select(
            F.floor(quoted(x) / cell).cast("bigint").alias("x_cell"),
            F.floor(quoted(y) / cell).cast("bigint").alias("y_cell"),
        )
        counted = cells.groupBy("x_cell", "y_cell").agg(F.count("*").alias("n"))
        parts.append(counted.select(F.lit(name).alias("dataset"), "*"))
    return parts[0].unionByName(parts[1])


def geo_sample(df: DataFrame, key: str, x: str, y: str, share: float, seed: int = 42) -> DataFrame:
    """Coordinates of a share of the rows, chosen by key so that the choice never depends on partitions."""
    pick = hash_bucket(key, 1_000_000, seed) < int(share * 1_000_000)
    return df.filter(all_present([x, y]) & pick).select(quoted(key), quoted(x), quoted(y))


def missing_bar(df: DataFrame, n: int = 12) -> DataFrame:
    return top_groups(missing_profile(df), "missing_percent", "column", n)


def residuals(df: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """(key, actual, predicted, residual) for the rows that have a prediction."""
    return df.filter(all_present([actual, predicted])).select(
        quoted(key),
        quoted(actual).alias("actual"),
        quoted(predicted).alias("predicted"),
        (quoted(actual) - quoted(predicted)).alias("residual"),
    )


def _r2(actual: Column, predicted: Column) -> Column:
    return F.lit(1.0) - F.sum(F.pow(actual - predicted, 2)) / (F.var_pop(actual) * F.count(actual))


def fit_line(table: DataFrame) -> DataFrame:
    """(line_low, line_high, r2) of the perfect-prediction line over a residual table."""
    actual, predicted = F.col("actual"), F.col("predicted")
    return table.agg(
        F.least(F.min(actual), F.min(predicted)).alias("line_low"),
        F.greatest(F.max(actual), F.max(predicted)).alias("line_high"),
        _r2(actual, predicted).alias("r2"),
    )


def qq_points(table: DataFrame, column: str = "residual", points: int = 99) -> DataFrame:
    """(prob, normal_quantile, sample_quantile, slope, intercept) on a fixed grid of probabilities."""
    grid = [(i + 1) / (points + 1) for i in range(points)]
    normal = F.create_map(*[F.lit(v) for p in grid for v in (p, NormalDist().inv_cdf(p))])
    sample = exact_quantiles(table, [column], grid).select(
        "prob", F.element_at(normal, F.col("prob")).alias("normal_quantile"),
        F.col("value").alias("sample_quantile"),
    )
    line = sample.agg(
        F.struct(
            F.regr_slope("sample_quantile", "normal_quantile").alias("slope"),
            F.regr_intercept("sample_quantile", "normal_quantile").alias("intercept"),
        ).alias("l")
    ).scalar()
    return sample.select("*", line.getField("slope").alias("slope"), line.getField("intercept").alias("intercept"))


def comparison_table(results: DataFrame, metric: str = "cv_mean") -> DataFrame:
    """(model, score, spread) of the models that ran, best first."""
    spread = metric.replace("_mean", "_std")
    error = F.col(spread) if spread != metric and spread in results.columns else F.lit(0.0)
    return (
        results.filter(F.col("error").isNull())
        .select("model", F.col(metric).alias("score"), error.alias("spread"))
        .orderBy(F.desc("score"), "model")
    )


