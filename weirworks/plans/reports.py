"""Exploration, validation, analysis and before/after reports, each as tables and as one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import (
    first_last_delta,
    long_rows,
    numeric_names,
    other_names,
    percent,
    quoted,
    row_mean,
)
from weirworks.operators import charts
from weirworks.operators.compare import compare_counts, compare_frames, compare_missing
from weirworks.operators.groups import group_stats, summary_metrics, top_groups, trend_counts, trend_shares
from weirworks.operators.profile import (
    categorical_profile,
    duplicate_count,
    frame_summary,
    joined_scores,
    numeric_profile,
    score_categorical,
    score_from_columns,
    score_numeric,
)
from weirworks.operators.schema import header_table, narrow_types, require_columns, suggest_names
from weirworks.plans.cleaning import CleaningRules, clean
from weirworks.session import materialised
from weirworks.sources.tables import scan_csv


def tidy(df: DataFrame, section: str, item: str | None, metrics: Sequence[str]) -> DataFrame:
    """(section, item, metric, value) of chosen number columns."""
    label = F.lit("all") if item is None else quoted(item).cast("string")
    numbers = df.select(label.alias("item"), *[quoted(m).cast("double").alias(m) for m in metrics])
    return numbers.unpivot("item", [quoted(m) for m in metrics], "metric", "value").select(
        F.lit(section).alias("section"), "item", "metric", "value"
    )


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def validation_report(
    df: DataFrame, required: Sequence[str] = (), min_rows: int = 1, missing_warn_percent: float = 0.5
) -> DataFrame:
    """(severity, check, item, value): findings only; a table without errors is valid."""
    names = df.columns
    single = df.agg(F.count("*").alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)])
    rows = F.col("rows")
    filled = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    missing = percent(rows * len(names) - filled, rows * len(names))

    def finding(severity, check, item, value, applies):
        return {
            "severity": F.lit(severity),
            "check": F.lit(check),
            "item": F.lit(item),
            "value": value.cast("double"),
            "applies": applies,
        }

    enough = (rows > 0) & (rows >= min_rows)
    findings = [finding("error", "too_few_rows", "all", rows, ~enough)]
    findings += [
        finding("error", "missing_required", c, F.lit(0), F.lit(True)) for c in required if c not in names
    ]
    findings += [
        finding("warning", "empty_column", c, rows, enough & (F.col(f"n{i}") == 0)) for i, c in enumerate(names)
    ]
    findings.append(finding("warning", "high_missing_percent", "all", missing, enough & (missing > missing_warn_percent)))
    plain = long_rows(single, findings).filter("applies").drop("applies")
    duplicates = duplicate_count(df).filter(F.col("duplicate_rows") > 0).select(
        F.lit("warning").alias("severity"),
        F.lit("duplicate_rows").alias("check"),
        F.lit("all").alias("item"),
        F.col("duplicate_rows").cast("double").alias("value"),
    )
    spelling = suggest_names(header_table(df)).select(
        F.lit("warning").alias("severity"),
        F.lit("name_suggestion").alias("check"),
        F.col("column").alias("item"),
        F.col("filled_rows").cast("double").alias("value"),
    )
    return stacked([plain, duplicates, spelling])


def require_valid(df: DataFrame, required: Sequence[str] = (), min_rows: int = 1) -> None:
    raise_errors(validation_report(df, required, min_rows))


def raise_errors(validation: DataFrame) -> None:
    found = validation.filter(F.col("severity") == "error").collect()
    if found:
        raise ValueError("validation failed: " + ", ".join(f"{r['check']} ({r['item']})" for r in found))


def explore(df: DataFrame, required: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Validation, metadata, column profiles with scores and the table score.

    Each table has a row per column at most; all are stored, because the score and the reader need them again.
    """
    tables = {"validation": validation_report(df, required), "metadata": frame_summary(df)}
    if numeric_names(df):
        tables["numeric"] = score_numeric(numeric_profile(df))
    if other_names(df):
        tables["categorical"] = score_categorical(categorical_profile(df))
    tables = {name: materialised(table, name) for name, table in tables.items()}
    profiles = [tables[kind] for kind in ("numeric", "categorical") if kind in tables]
    return {**tables, "score": score_from_columns(joined_scores(profiles))}


def load_and_explore(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    required: Sequence[str] = (),
    narrow: bool = False,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Read, check and profile one CSV table; a failed check raises."""
    df = materialised(scan_csv(spark, path, schema, columns, required), "loaded")  # text is parsed once
    tables = explore(df, required)
    raise_errors(tables["validation"])
    return (narrow_types(df) if narrow else df), tables


def exploration_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    numeric = ("count", "mean", "std", "min", "q25", "median", "q75", "max", "missing_percent", "quality_score")
    other = ("count", "unique_count", "unique_percent", "top_frequency", "missing_percent", "quality_score")
    profiles = [
        tidy(tables[kind], kind, "column", metrics)
        for kind, metrics in (("numeric", numeric), ("categorical", other))
        if kind in tables
    ]
    return stacked(
        [
            tidy(tables["metadata"], "metadata", None, ("rows", "columns", "missing_percent", "duplicate_rows")),
            *profiles,
            tidy(tables["score"], "score", None, ("scored_columns", "mean_score", "quality_score")),
            tables["validation"].select(
                F.lit("validation").alias("section"), "item", F.col("check").alias("metric"), "value"
            ),
        ]
    )


def load_scenarios(
    spark: SparkSession, path: str, schema: T.StructType, selected: Sequence[str], required: Sequence[str]
) -> DataFrame:
    """(scenario, rows, columns, missing_percent, duplicate_rows, warnings) for three ways to load a table.

    Block size never changes a result, so it is not one of the scenarios (see ``scan_split``).
    """
    whole = materialised(scan_csv(spark, path, schema), "loaded")
    variants = {
        "default": narrow_types(whole),
        "selected_columns": narrow_types(scan_csv(spark, path, schema, selected, required)),
        "wide_types": whole,
    }
    parts = []
    for name, df in variants.items():
        warnings = validation_report(df).filter(F.col("severity") == "warning").agg(F.count("*")).scalar()
        parts.append(frame_summary(df).select(F.lit(name).alias("scenario"), "*", warnings.alias("warnings")))
    return stacked(parts)


def with_measures(df: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Adds the row mean and the first-to-last delta of the period columns."""
    return df.withColumns({"row_mean": row_mean(periods), "trend_delta": first_last_delta(periods)})


def analyse(df: DataFrame, company: str, region: str, periods: Sequence[str], top_n: int = 10) -> dict[str, DataFrame]:
    """Group statistics, trends, summary and the chart tables of the exploratory analysis."""
    require_columns(df, [company])
    if not df.take(1):
        raise ValueError("cannot analyse an empty table")
    kept = [quoted(k) for k in dict.fromkeys((company, region)) if k in df.columns]
    measured = materialised(with_measures(df, periods).select(*kept, "row_mean", "trend_delta"), "measured")
    companies = materialised(group_stats(measured, company, "row_mean"), "companies")
    regions = materialised(group_stats(measured, region, "row_mean"), "regions")
    keys = [k for k in (company, region) if k in df.columns]
    return {
        "companies": companies,
        "regions": regions,
        "trends": trend_counts(measured, "trend_delta"),
        "summary": summary_metrics(measured, "row_mean", "trend_delta", keys),
        "top_companies": top_groups(companies, "mean", company, top_n),
        "top_regions": top_groups(regions, "mean", region, top_n),
        "distribution": charts.histogram(measured, "row_mean"),
        "trend_shares": trend_shares(measured, "trend_delta"),
    }


def analysis_table(tables: Mapping[str, DataFrame], company: str, region: str) -> DataFrame:
    stats = ("mean", "median", "total", "site_count", "std", "min", "max")
    return stacked(
        [
            tidy(tables["companies"], "company", company, stats),
            tidy(tables["regions"], "region", region, stats),
            tidy(tables["trends"], "trend", None, ("overall_trend", "improving", "worsening", "stable")),
            tables["summary"].select(F.lit("summary").alias("section"), F.lit("all").alias("item"), "metric", "value"),
            tidy(tables["trend_shares"], "trend_share", "label", ("n", "share_percent")),
            tidy(tables["distribution"], "distribution", "bin", ("n",)),
        ]
    )


def before_after(
    df: DataFrame, rules: CleaningRules, columns: Sequence[str], value: str, group: str, cell: float
) -> DataFrame:
    """(section, item, metric, value) comparing a table with its cleaned form; metric starts with the data set.

    ``value`` is the period column whose density is compared; its footprint is taken against the first bound column.
    """
    df = materialised(df, "before")
    cleaned = materialised(clean(df, rules), "after")
    raw = df.withColumn(value, quoted(value).try_cast("double"))
    anchor = next(iter(rules.bounds))
    frames = compare_frames(df, cleaned)
    missing = compare_missing(df, cleaned, columns)
    counts = compare_counts(df, cleaned, group)
    shift = charts.density_shift(raw, cleaned, value)
    footprint = charts.geo_footprint(raw, cleaned, anchor, value, cell)
    place = F.concat_ws("/", F.col("x_cell").cast("string"), F.col("y_cell").cast("string"))

    def part(section, table, item, metric, number):
        return table.select(
            F.lit(section).alias("section"), item.alias("item"), metric.alias("metric"), number.cast("double").alias("value")
        )

    dataset = F.col("dataset")
    return stacked(
        [
            *[
                part("frame", frames, F.lit(m), dataset, F.col(m))
                for m in ("rows", "columns", "missing_percent", "duplicate_rows")
            ],
            part("missing", missing, F.col("column"), dataset, F.col("missing_percent")),
            part("counts", counts, F.col("value"), F.lit("raw"), F.col("raw")),
            part("counts", counts, F.col("value"), F.lit("cleaned"), F.col("cleaned")),
            part("density", shift, F.col("bin").cast("string"), dataset, F.col("density")),
            part("footprint", footprint, place, dataset, F.col("n")),
        ]
    )
