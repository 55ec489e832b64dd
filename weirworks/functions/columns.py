"""Row-wise column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space for a full strip (SQL trim knows blanks only).
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Strings a source file uses for "missing".
SENTINELS = (
    "",
    "TBC",
    "Pending Investigation",
    "N/A",
    "Unknown",
    "Not Available",
    "null",
    "NULL",
)

# Strings a CSV reader of the pandas family takes as missing by default.
DEFAULT_MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_names(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if is_numeric(field.dataType)]


def other_names(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if not is_numeric(field.dataType)]


def text_names(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if isinstance(field.dataType, T.StringType)]


def strip(value: Column) -> Column:
    """Strip white space of every kind; nothing left means missing."""
    return F.nullif(F.btrim(value, F.lit(WHITESPACE)), F.lit(""))


def to_number(value: Column) -> Column:
    """Text to double; what does not parse becomes missing, and so does NaN."""
    return F.nullif(value.try_cast("double"), F.lit(float("nan")))


def to_flag(value: Column) -> Column:
    """Yes/No, true/false or 1/0 to an integer; anything else is missing."""
    return value.cast("string").try_cast("boolean").cast("int")


def missing_count(names: Sequence[str]) -> Column:
    return reduce(add, (quoted(n).isNull().cast("int") for n in names), F.lit(0))


def row_hash(df: DataFrame, names: Sequence[str]) -> Column:
    """A 128-bit digest of a row: equal exactly for rows that a grouping would put together.

    Two different rows share one with a chance of about 1e-15 at 10^11 rows.
    """
    fractions = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    # Zero has two signs, which a grouping does not tell apart.
    parts = [(F.when(quoted(n) == 0, 0.0).otherwise(quoted(n)) if n in fractions else quoted(n)).alias(f"c{i}") for i, n in enumerate(names)]
    return F.unhex(F.md5(F.to_json(F.struct(*parts)).cast("binary")))


def present_count(names: Sequence[str]) -> Column:
    return reduce(add, (quoted(n).isNotNull().cast("int") for n in names), F.lit(0))


def all_present(names: Sequence[str]) -> Column:
    return reduce(and_, (quoted(n).isNotNull() for n in names), F.lit(True))


def any_present(names: Sequence[str]) -> Column:
    return reduce(or_, (quoted(n).isNotNull() for n in names), F.lit(False))


def row_mean(names: Sequence[str]) -> Column:
    """Mean of the values present in a row; 0 when there is no column to average."""
    if not names:
        return F.lit(0.0)
    total = reduce(add, (F.coalesce(quoted(n).cast("double"), F.lit(0.0)) for n in names))
    return F.when(present_count(names) > 0, total / present_count(names))


def first_last_delta(names: Sequence[str]) -> Column:
    """Last minus first column in name order; a missing end counts as 0."""
    ordered = sorted(names)
    if len(ordered) < 2:
        raise ValueError("a trend needs at least two period columns")
    first, last = (F.coalesce(quoted(n).cast("double"), F.lit(0.0)) for n in (ordered[0], ordered[-1]))
    return last - first


def both_ends_present(names: Sequence[str]) -> Column:
    ordered = sorted(names)
    return quoted(ordered[0]).isNotNull() & quoted(ordered[-1]).isNotNull()


def trend_label(delta: Column) -> Column:
    """Fewer events is an improvement."""
    return F.when(delta < 0, "improving").when(delta > 0, "worsening").when(delta == 0, "stable")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def clamp_score(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def numeric_score(missing_pct: Column, outlier_pct: Column, has_moments: Column) -> Column:
    """0 to 100 for a numeric column."""
    penalty = missing_pct * 0.5 + outlier_pct * 0.3 + F.when(has_moments, 0.0).otherwise(20.0)
    return clamp_score(F.lit(100.0) - penalty)


def categorical_score(missing_pct: Column, unique_pct: Column, has_mode: Column) -> Column:
    """0 to 100 for a text column."""
    penalty = (
        missing_pct * 0.5
        + F.when(unique_pct > 90, 20.0).otherwise(0.0)
        + F.when(has_mode, 0.0).otherwise(10.0)
    )
    return clamp_score(F.lit(100.0) - penalty)


def dataset_score(mean_score: Column, missing_pct: Column) -> Column:
    return F.coalesce(clamp_score(mean_score - missing_pct * 0.3), F.lit(0.0))


def long_rows(single: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row frame into one row per entry of ``rows`` (same keys in each)."""
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return single.select(F.inline(F.array(*structs)))
