"""Row rules: filters, column rewrites and the findings they report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import (
    all_present,
    any_present,
    is_numeric,
    long_rows,
    missing_count,
    numeric_names,
    percent,
    present_count,
    quoted,
    strip,
    to_flag,
    to_number,
)
from weirworks.operators.quantiles import quantile_values

Bounds = Mapping[str, tuple[float, float]]


def blank_nan(df: DataFrame) -> DataFrame:
    """NaN becomes missing, so that no aggregate or comparison ever meets it."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: F.nullif(quoted(name), F.lit(float("nan")).cast(df.schema[name].dataType)) for name in floating})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse becomes missing."""
    return df.withColumns({name: to_number(quoted(name)) for name in columns})


def flags_to_int(df: DataFrame, marker: str = "Flag") -> DataFrame:
    """Every column with ``marker`` in its name becomes 0, 1 or missing."""
    return df.withColumns({name: to_flag(quoted(name)) for name in df.columns if marker in name})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(all_present(columns))


def range_filter(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Keep rows inside every inclusive range; a missing value is outside."""
    for name, (low, high) in bounds.items():
        df = df.filter(quoted(name).between(low, high))
    return df


def outside(name: str, low: float, high: float) -> Column:
    """True outside the range and for a missing value."""
    return F.coalesce(~quoted(name).between(low, high), F.lit(True))


def range_violations(df: DataFrame, bounds: Bounds) -> DataFrame:
    """(metric, invalid_rows, low, high), missing values counted as invalid."""
    single = df.agg(
        *[F.count_if(outside(name, lo, hi)).alias(f"v{i}") for i, (name, (lo, hi)) in enumerate(bounds.items())]
    )
    return long_rows(
        single,
        [
            {"metric": F.lit(name), "invalid_rows": F.col(f"v{i}"), "low": F.lit(float(lo)), "high": F.lit(float(hi))}
            for i, (name, (lo, hi)) in enumerate(bounds.items())
        ],
    )


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample deviation of each column from one pass; one row comes back."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(quoted(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def is_outlier(name: str, mean: float | None, deviation: float | None, threshold: float) -> Column:
    if mean is None or not deviation:
        return F.lit(False)
    return F.coalesce(F.abs((quoted(name) - F.lit(mean)) / F.lit(deviation)) > threshold, F.lit(False))


def null_outliers(
    df: DataFrame,
    columns: Sequence[str],
    threshold: float = 3.0,
    stats: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Blank values further than ``threshold`` deviations from the mean; rows stay."""
    stats = moments(df, columns) if stats is None else stats
    return df.withColumns({c: F.when(~is_outlier(c, *stats[c], threshold), quoted(c)) for c in columns})


def min_valid_columns(df: DataFrame, columns: Sequence[str], minimum: int = 3) -> DataFrame:
    return df.filter(present_count(columns) >= minimum)


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strip(quoted(c)) for c in columns})


def drop_all_empty_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(any_present(columns))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per set of identical rows, over the whole table."""
    return df.dropDuplicates()


def is_sparse(columns: Sequence[str], threshold: float) -> Column:
    return missing_count(columns) / F.lit(len(columns)) > threshold


def drop_sparse_rows(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Drop rows whose missing share over all columns lies above the threshold."""
    return df.filter(~is_sparse(df.columns, threshold))


def fill_constant(df: DataFrame, value: float | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing values of the columns whose type fits the constant."""
    fits = is_numeric if not isinstance(value, str) else lambda t: isinstance(t, T.StringType)
    chosen = [f for f in df.schema if fits(f.dataType) and (columns is None or f.name in columns)]
    return df.withColumns({f.name: F.coalesce(quoted(f.name), F.lit(value).cast(f.dataType)) for f in chosen})


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column median; an empty column stays empty."""
    columns = numeric_names(df) if columns is None else list(columns)
    found = quantile_values(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(found[c][0])) for c in columns if c in found})


def percentile_cap(df: DataFrame, column: str, percentile: float = 99.0) -> DataFrame:
    """Keep rows at or below the percentile of ``column``."""
    found = quantile_values(df, [column], [percentile / 100.0])
    cutoff = found[column][0] if column in found else None
    return df.filter(quoted(column) <= F.lit(cutoff).cast("double"))


def cap_summary(df: DataFrame, column: str, percentile: float = 99.0) -> DataFrame:
    """(cutoff, kept_rows, excluded_rows) of ``percentile_cap``."""
    found = quantile_values(df, [column], [percentile / 100.0])
    cutoff = F.lit(found[column][0] if column in found else None).cast("double")
    kept = F.count_if(quoted(column) <= cutoff)
    return df.agg(F.max(cutoff).alias("cutoff"), kept.alias("kept_rows"), (F.count("*") - kept).alias("excluded_rows"))


def project_features(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), stand_ins: int = 0
) -> DataFrame:
    """Key, feature and target columns.

    If one is absent, the first numeric column stands in as target and up to ``stand_ins`` others as features; with none
    allowed, the default, that is an error.
    """
    absent = [name for name in [*features, target] if name not in df.columns]
    if not absent:
        return df.select(*map(quoted, [*keys, *features, target]))
    if not stand_ins:
        raise ValueError(f"absent columns: {absent}")
    numeric = [n for n in numeric_names(df) if n not in keys]
    if len(numeric) < 2:
        raise ValueError("a stand-in needs one numeric target and at least one numeric feature")
    return df.select(*map(quoted, [*keys, *numeric[1 : 1 + stand_ins], numeric[0]]))


def input_gate(df: DataFrame, required: Sequence[str], min_rows: int = 1, drop_incomplete: bool = True) -> DataFrame:
    """(check, ok, detail): enough rows, required columns there, and how many rows are complete."""
    absent = [c for c in required if c not in df.columns]
    there = [c for c in required if c in df.columns]
    single = df.agg(F.count("*").alias("rows"), F.count_if(all_present(there)).alias("complete"))
    rows, complete = F.col("rows"), F.col("complete")
    usable = complete if drop_incomplete else rows
    checks = [
        {"check": F.lit("not_empty"), "ok": rows > 0, "detail": rows},
        {"check": F.lit("required_columns"), "ok": F.lit(not absent), "detail": F.lit(len(absent)).cast("bigint")},
        {"check": F.lit("min_rows"), "ok": usable >= min_rows, "detail": usable},
        {
            "check": F.lit("complete_rows"),
            "ok": F.lit(drop_incomplete) | (complete == rows),
            "detail": rows - complete,
        },
    ]
    return long_rows(single, checks)


def require_input(df: DataFrame, required: Sequence[str], min_rows: int = 1, drop_incomplete: bool = True) -> DataFrame:
    """Raise on a failed gate, else hand on the complete rows."""
    failed = [r for r in input_gate(df, required, min_rows, drop_incomplete).collect() if not r["ok"]]
    if failed:
        raise ValueError("input rejected: " + ", ".join(f"{r['check']} ({r['detail']})" for r in failed))
    return drop_missing(df, required)


def rule_violations(
    df: DataFrame,
    required: Sequence[str] = (),
    bounds: Bounds | None = None,
    missing_threshold: float = 0.1,
) -> DataFrame:
    """Findings of one pass: absent required columns, values out of range, columns with too much missing.

    (rule, column, affected_rows, total_rows, affected_percent, threshold, severity)
    """
    bounds = bounds or {}
    present = [c for c in required if c in df.columns]
    watched = list(dict.fromkeys([*present, *bounds]))
    single = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(~quoted(c).between(lo, hi)).alias(f"r{i}") for i, (c, (lo, hi)) in enumerate(bounds.items())],
        *[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(watched)],
    )
    rows = F.col("rows")

    def finding(rule: str, column: str, affected: Column, threshold: float, severity: str) -> dict[str, Column]:
        return {
            "rule": F.lit(rule),
            "column": F.lit(column),
            "affected_rows": affected,
            "total_rows": rows,
            "affected_percent": percent(affected, rows),
            "threshold": F.lit(float(threshold)),
            "severity": F.lit(severity),
        }

    findings = [finding("column", c, rows, 0.0, "error") for c in required if c not in df.columns]
    findings += [finding("range", c, F.col(f"r{i}"), 0.0, "error") for i, c in enumerate(bounds)]
    findings += [finding("quality", c, F.col(f"m{i}"), missing_threshold, "warning") for i, c in enumerate(watched)]
    limit = F.col("threshold") * 100.0
    return long_rows(single, findings).filter((F.col("affected_rows") > 0) & (F.col("affected_percent") > limit))
