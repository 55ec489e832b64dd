"""Group statistics, trends, top groups and group values handed back to the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import long_rows, numeric_names, quoted, trend_label
from weirworks.operators.quantiles import exact_quantiles, quantile_table
from weirworks.operators.small import broadcast_if_small


def group_stats(df: DataFrame, key: str, value: str, digits: int | None = 2) -> DataFrame:
    """Mean, median, sum, number of values, deviation, min and max per group; groups without a key are left out.

    A key the table does not have gives an empty result.
    """
    names = ("mean", "median", "total", "site_count", "std", "min", "max")
    if key not in df.columns:
        shape = ", ".join(f"{n} {'bigint' if n == 'site_count' else 'double'}" for n in names)
        return df.sparkSession.createDataFrame([], f"`{key}` string, {shape}")
    keyed = df.filter(quoted(key).isNotNull()).select(quoted(key), quoted(value).cast("double").alias("value"))
    stats = keyed.groupBy(quoted(key)).agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.count("value").alias("site_count"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    medians = quantile_table(keyed, ["value"], {"median": 0.5}, [key]).drop("column")
    joined = stats.join(medians, key, "left").select(quoted(key), *names)
    if digits is None:
        return joined
    return joined.withColumns({n: F.round(quoted(n), digits) for n in names if n != "site_count"})


def rename_round(df: DataFrame, names: Mapping[str, str], digits: int = 2) -> DataFrame:
    """Columns under the given names, all doubles and floats rounded, ready to be read; other columns stay as they are.

    Names of columns the table does not have are passed over.
    """
    real = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            (F.round(quoted(c), digits) if c in real else quoted(c)).alias(names.get(c, c))
            for c in df.columns
        ]
    )


def sort_desc(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(quoted(column).desc_nulls_last(), quoted(tie))


def top_groups(df: DataFrame, column: str, tie: str, n: int = 10) -> DataFrame:
    return sort_desc(df, column, tie).limit(n)


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order, the same ones on every run."""
    return df.orderBy(quoted(key)).limit(n)


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    return top_groups(importances, "importance", "feature", n)


def trend_counts(df: DataFrame, delta: str) -> DataFrame:
    """(overall_trend, improving, worsening, stable, labelled) over all rows."""
    value = quoted(delta)
    return df.agg(
        F.avg(value).alias("overall_trend"),
        F.count_if(value < 0).alias("improving"),
        F.count_if(value > 0).alias("worsening"),
        F.count_if(value == 0).alias("stable"),
        F.count(value).alias("labelled"),
    )


def trend_shares(df: DataFrame, delta: str) -> DataFrame:
    """(label, n, share_percent) for the three trend labels, zero counts included."""
    counts = trend_counts(df, delta)
    total = F.col("improving") + F.col("worsening") + F.col("stable")
    return long_rows(
        counts,
        [
            {
                "label": F.lit(label),
                "n": F.col(label),
                "share_percent": F.when(total > 0, F.col(label) * 100.0 / total).otherwise(0.0),
            }
            for label in ("improving", "worsening", "stable")
        ],
    )


def summary_metrics(df: DataFrame, value: str, delta: str | None, keys: Sequence[str]) -> DataFrame:
    """(metric, value): rows, distinct keys, moments, truncated total, percentiles and trend counts."""
    measure = quoted(value).cast("double")
    trend = quoted(delta) if delta else F.lit(None).cast("double")
    single = df.agg(
        F.count("*").alias("rows"),
        F.avg(measure).alias("mean"),
        F.stddev_samp(measure).alias("std"),
        F.min(measure).alias("min"),
        F.max(measure).alias("max"),
        F.coalesce(F.sum(measure), F.lit(0.0)).cast("bigint").alias("total"),
        F.avg(trend).alias("overall_trend"),
        F.count_if(trend < 0).alias("improving"),
        F.count_if(trend > 0).alias("worsening"),
        F.count_if(trend == 0).alias("stable"),
        *[F.count_distinct(quoted(k)).alias(f"distinct_{k}") for k in keys],
    )
    plain = long_rows(
        single, [{"metric": F.lit(n), "value": F.col(f"`{n}`").cast("double")} for n in single.columns]
    )
    percentiles = exact_quantiles(df, [value], [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
    label = F.concat(F.lit("percentile_"), F.round(F.col("prob") * 100).cast("int").cast("string"))
    return plain.unionByName(percentiles.select(label.alias("metric"), "value"))


def label_trends(df: DataFrame, delta: str, label: str = "trend_label") -> DataFrame:
    return df.withColumn(label, trend_label(quoted(delta)))


def group_stat_features(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, deviation, min and max of the row's group next to each row.

    A small group table is broadcast; a large one is joined by shuffle, where adaptive execution splits hot keys.
    """
    columns = [c for c in numeric_names(df) if c != key] if columns is None else list(columns)
    stats = df.filter(quoted(key).isNotNull()).groupBy(quoted(key)).agg(
        *[
            expression
            for c in columns
            for expression in (
                F.avg(quoted(c)).alias(f"{c}_group_mean"),
                F.stddev_samp(quoted(c)).alias(f"{c}_group_std"),
                F.min(quoted(c)).alias(f"{c}_group_min"),
                F.max(quoted(c)).alias(f"{c}_group_max"),
            )
        ]
    )
    return df.join(broadcast_if_small(stats), key, "left")


def global_stat_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and deviation of the whole column next to each row, from a scalar subquery."""
    columns = numeric_names(df) if columns is None else list(columns)
    single = F.struct(
        *[F.avg(quoted(c)).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(quoted(c)).alias(f"{c}_std") for c in columns],
    )
    stats = df.agg(single.alias("s")).scalar()
    names = [f"{c}_{kind}" for c in columns for kind in ("mean", "std")]
    return df.select("*", *[stats.getField(n).alias(n) for n in names])
