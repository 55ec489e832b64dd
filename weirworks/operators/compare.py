"""Before/after comparisons, pivots and the reverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import quoted
from weirworks.operators.profile import frame_summary, missing_profile


def compare_counts(before: DataFrame, after: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, raw, cleaned): the values in the top k of either frame, with their counts in both."""
    sides = before.select(quoted(column).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(quoted(column).alias("value"), F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    counts = sides.filter("value IS NOT NULL").groupBy("value").agg(F.sum("b").alias("raw"), F.sum("a").alias("cleaned"))
    tops = [counts.filter(F.col(c) > 0).orderBy(F.desc(c), "value").limit(k) for c in ("raw", "cleaned")]
    return tops[0].unionAll(tops[1]).distinct()


def compare_missing(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, dataset, missing_percent) for both frames."""
    parts = [
        missing_profile(df, columns).select("column", F.lit(name).alias("dataset"), "missing_percent")
        for name, df in (("raw", before), ("cleaned", after))
    ]
    return parts[0].unionByName(parts[1])


def compare_frames(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dataset, rows, columns, missing_percent, duplicate_rows) for both frames."""
    parts = [
        frame_summary(df).select(F.lit(name).alias("dataset"), "*")
        for name, df in (("raw", before), ("cleaned", after))
    ]
    return parts[0].unionByName(parts[1])


def stack_labelled(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """All frames below one another with the dictionary key in a column."""
    frames = [df.select(F.lit(name).alias(label), "*") for name, df in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def removal_matrix(breakdown: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Rule by strategy, absent ones as 0, rules in descending order."""
    return (
        breakdown.groupBy("rule")
        .pivot("strategy", list(strategies))
        .agg(F.sum("rows_removed"))
        .fillna(0)
        .orderBy(F.desc("rule"))
    )


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([quoted(i) for i in ids], [quoted(c) for c in columns], name, value)
