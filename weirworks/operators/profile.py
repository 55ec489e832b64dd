"""Profiles: missing values, duplicates, column statistics and quality scores as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import (
    categorical_score,
    dataset_score,
    long_rows,
    missing_count,
    numeric_names,
    numeric_score,
    other_names,
    percent,
    quoted,
    row_hash,
    strip,
)
from weirworks.operators.quantiles import quantile_table
from weirworks.operators.rules import is_outlier, moments
from weirworks.operators.small import broadcast_if_small

HEAD = 64  # leading characters of a text that are counted with its digest


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, missing, missing_percent) from one pass."""
    columns = df.columns if columns is None else columns
    single = df.agg(F.count("*").alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.col("rows")
    return long_rows(
        single,
        [
            {
                "column": F.lit(c),
                "rows": rows,
                "missing": rows - F.col(f"n{i}"),
                "missing_percent": percent(rows - F.col(f"n{i}"), rows),
            }
            for i, c in enumerate(columns)
        ],
    )


def missing_overall(df: DataFrame) -> DataFrame:
    """(cells, missing, missing_percent) over the whole table."""
    cells = F.count("*") * F.lit(len(df.columns))
    missing = F.coalesce(F.sum(missing_count(df.columns)), F.lit(0)).cast("bigint")
    return df.agg(cells.alias("cells"), missing.alias("missing")).withColumn(
        "missing_percent", percent(F.col("missing"), F.col("cells"))
    )


def empty_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return missing_profile(df, columns).filter(F.col("missing") == F.col("rows")).select("column", "rows")


def row_groups(df: DataFrame) -> DataFrame:
    """(hash, copies, missing): a row for each different row, with its number of copies and of missing values.

    Digests and counts move through the network, not the rows; copies meet before that.
    """
    digests = df.select(row_hash(df, df.columns).alias("hash"), missing_count(df.columns).alias("missing"))
    return digests.groupBy("hash").agg(F.count("*").alias("copies"), F.max("missing").alias("missing"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows) over the whole table."""
    return row_groups(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def shape_metadata(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def frame_summary(df: DataFrame) -> DataFrame:
    """(rows, columns, missing_percent, duplicate_rows) from one grouping of identical rows."""
    width = len(df.columns)
    grouped = row_groups(df)
    rows = F.coalesce(F.sum("copies"), F.lit(0))
    missing = F.coalesce(F.sum(F.col("copies") * F.col("missing")), F.lit(0))
    return grouped.agg(
        rows.alias("rows"),
        F.lit(width).cast("bigint").alias("columns"),
        percent(missing, rows * width).alias("missing_percent"),
        (rows - F.count("*")).alias("duplicate_rows"),
    )


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probs: dict[str, float] | None = None,
    outlier_z: float | None = None,
) -> DataFrame:
    """Per numeric column: count, mean, std, min, quantiles, max, missing and outlier shares.

    Outliers are counted only when ``outlier_z`` is given; that needs the moments first, so one pass more.
    """
    columns = numeric_names(df) if columns is None else list(columns)
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75} if probs is None else probs
    stats = moments(df, columns) if outlier_z is not None else {}

    def outliers(name: str) -> Column:
        return F.count_if(is_outlier(name, *stats[name], outlier_z)) if stats else F.lit(0).cast("bigint")

    single = df.agg(
        F.count("*").alias("rows"),
        *[
            F.struct(
                F.count(quoted(c)).alias("count"),
                F.avg(quoted(c)).alias("mean"),
                F.stddev_samp(quoted(c)).alias("std"),
                F.min(quoted(c)).cast("double").alias("min"),
                F.max(quoted(c)).cast("double").alias("max"),
                outliers(c).alias("outlier_count"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ],
    )
    rows = F.col("rows")
    table = long_rows(
        single,
        [
            {
                "column": F.lit(c),
                "count": F.col(f"s{i}.count"),
                "mean": F.col(f"s{i}.mean"),
                "std": F.col(f"s{i}.std"),
                "min": F.col(f"s{i}.min"),
                "max": F.col(f"s{i}.max"),
                "missing_count": rows - F.col(f"s{i}.count"),
                "missing_percent": percent(rows - F.col(f"s{i}.count"), rows),
                "outlier_count": F.col(f"s{i}.outlier_count"),
                "outlier_percent": percent(F.col(f"s{i}.outlier_count"), F.col(f"s{i}.count")),
            }
            for i, c in enumerate(columns)
        ],
    )
    if not probs:
        return table
    return table.join(F.broadcast(quantile_table(df, columns, probs)), "column", "left")  # one row per column


def digest_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, digest, head, length, n) for each different text and, with null digest and head, the missing value.

    Texts are told apart by a 128-bit digest; of the text itself only its first ``HEAD`` characters move with it.
    """
    pairs = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]
    value = F.col("value")
    return (
        df.select(F.inline(F.array(*pairs)))
        .select("column", F.unhex(F.md5(value)).alias("digest"), _head(value).alias("head"), F.length(value).alias("length"))
        .groupBy("column", "digest", "head", "length")
        .agg(F.count("*").alias("n"))
    )


def _head(value: Column) -> Column:
    return F.substring(value, 1, HEAD)


def _whole_modes(df: DataFrame, modes: dict[str, tuple[str, int]]) -> dict[str, str]:
    """The smallest of the most frequent texts of columns whose mode is longer than its head.

    ``modes`` holds the head and the frequency of each column's mode. Only rows with that head are counted again, and
    only texts whose digest has that frequency are fetched; equal frequencies of texts with one head are decided there.
    """
    pairs = [
        F.struct(F.lit(c).alias("column"), F.when(_head(text) == F.lit(head), text).alias("value"), F.lit(n).cast("bigint").alias("most"))
        for c, (head, n) in modes.items()
        for text in [quoted(c).cast("string")]
    ]
    rows = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    keyed = rows.select("*", F.unhex(F.md5("value")).alias("digest"))
    counted = keyed.groupBy("column", "digest").agg(F.count("*").alias("n"), F.first("most").alias("most"))
    tied = broadcast_if_small(counted.filter(F.col("n") == F.col("most")).select("column", "digest"))
    found = keyed.join(tied, ["column", "digest"], "left_semi").groupBy("column").agg(F.min("value").alias("value"))
    return {row["column"]: row["value"] for row in found.collect()}  # one row per column


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: count, distinct, mode (smallest of the most frequent), missing share.

    One grouping by (column, digest) serves all columns. Its totals are fetched, one row per column; a mode longer than
    ``HEAD`` characters takes a second pass over the rows that begin like it.
    """
    columns = other_names(df) if columns is None else list(columns)
    present = F.col("digest").isNotNull()
    top = F.min(F.when(present, F.struct((-F.col("n")).alias("rank"), F.col("head"), (-F.col("length")).alias("shortness"))))
    totals = (
        digest_counts(df, columns)
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
            F.count("digest").alias("unique_count"),
            top.alias("top"),
        )
        .collect()
    )
    # Of equal heads the longest text comes first, so a mode that fits its head has no longer text tied with it.
    cut = {
        r["column"]: (r["top"]["head"], -r["top"]["rank"]) for r in totals if r["top"] and -r["top"]["shortness"] > HEAD
    }
    whole = _whole_modes(df, cut) if cut else {}
    fixed = [
        (
            r["column"],
            r["rows"],
            r["count"],
            r["unique_count"],
            whole.get(r["column"], r["top"]["head"] if r["top"] else None),
            -r["top"]["rank"] if r["top"] else 0,
        )
        for r in totals
    ]
    schema = "column string, rows long, count long, unique_count long, top_value string, top_frequency long"
    missing = F.col("rows") - F.col("count")
    return df.sparkSession.createDataFrame(fixed, schema).select(
        "column",
        "count",
        "unique_count",
        percent(F.col("unique_count"), F.col("count")).alias("unique_percent"),
        "top_value",
        "top_frequency",
        missing.alias("missing_count"),
        percent(missing, F.col("rows")).alias("missing_percent"),
    )


def score_numeric(profile: DataFrame) -> DataFrame:
    has_moments = F.col("mean").isNotNull() & F.col("std").isNotNull()
    score = numeric_score(F.col("missing_percent"), F.col("outlier_percent"), has_moments)
    return profile.withColumn("quality_score", score)


def score_categorical(profile: DataFrame) -> DataFrame:
    score = categorical_score(F.col("missing_percent"), F.col("unique_percent"), F.col("top_value").isNotNull())
    return profile.withColumn("quality_score", score)


def joined_scores(parts: Sequence[DataFrame]) -> DataFrame:
    """(column, count, missing_count, quality_score) of scored profiles; columns without values have no score."""
    score = F.when(F.col("count") > 0, F.col("quality_score")).alias("quality_score")
    chosen = [part.select("column", "count", "missing_count", score) for part in parts]
    return chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])


def column_scores(df: DataFrame, outlier_z: float | None = None) -> DataFrame:
    """``joined_scores`` over all columns of a table."""
    numeric, other = numeric_names(df), other_names(df)
    parts = []
    if numeric:
        parts.append(score_numeric(numeric_profile(df, numeric, probs={}, outlier_z=outlier_z)))
    if other:
        parts.append(score_categorical(categorical_profile(df, other)))
    return joined_scores(parts)


def score_dataset(df: DataFrame, outlier_z: float | None = None) -> DataFrame:
    """(scored_columns, mean_score, missing_percent, quality_score) in one row."""
    return score_from_columns(column_scores(df, outlier_z))


def score_from_columns(scores: DataFrame) -> DataFrame:
    cells = F.sum(F.col("count") + F.col("missing_count"))
    return scores.agg(
        F.count("quality_score").alias("scored_columns"),
        F.avg("quality_score").alias("mean_score"),
        percent(F.sum("missing_count"), cells).alias("missing_percent"),
    ).withColumn("quality_score", dataset_score(F.col("mean_score"), F.col("missing_percent")))


def basic_describe(df: DataFrame) -> DataFrame:
    """Long form (column, metric, value) of the plain profile: describe, missing above zero, distinct."""
    numeric = numeric_profile(df)
    metrics = ("count", "mean", "std", "min", "q25", "median", "q75", "max")
    numeric_long = numeric.unpivot("column", [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    other = categorical_profile(df)
    kinds = ("unique_count", "unique_percent", "top_frequency")
    other_long = other.unpivot("column", [F.col(m).cast("double").alias(m) for m in kinds], "metric", "value")
    missing = missing_profile(df).filter(F.col("missing") > 0)
    missing_long = missing.unpivot(
        "column", [F.col(m).cast("double").alias(m) for m in ("missing", "missing_percent")], "metric", "value"
    )
    return numeric_long.unionByName(other_long).unionByName(missing_long)


def describe_percentiles(df: DataFrame, columns: Sequence[str], percentiles: Sequence[int]) -> DataFrame:
    """Describe a column group with chosen percentiles, one output column ``p<percentile>`` each."""
    probs = {f"p{p}": p / 100.0 for p in percentiles}
    return numeric_profile(df, columns, probs).drop("outlier_count", "outlier_percent")


def period_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(period, total_events): the sum of each period column."""
    single = df.agg(*[F.coalesce(F.sum(quoted(c)), F.lit(0.0)).alias(f"t{i}") for i, c in enumerate(columns)])
    return long_rows(single, [{"period": F.lit(c), "total_events": F.col(f"t{i}")} for i, c in enumerate(columns)])


def text_health(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column after a full strip: missing share, distinct values, mode; worst first."""
    nan_blank = {c: F.nullif(strip(quoted(c).cast("string")), F.lit("nan")) for c in columns}
    profile = categorical_profile(df.select(*[value.alias(c) for c, value in nan_blank.items()]), columns)
    return profile.select("column", "missing_percent", "unique_count", "top_value", "top_frequency").orderBy(
        F.desc("missing_percent"), "column"
    )


def value_counts_topk(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    return (
        df.filter(quoted(column).isNotNull())
        .groupBy(quoted(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )
