"""Checks on column names and types, and the type decisions that follow from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import is_numeric, long_rows, quoted
from weirworks.operators.profile import digest_counts

# The column names a site table may use, by kind.
NAME_PATTERNS = {
    "coordinate": r"^(Latitude|Longitude|Easting|Northing)$",
    "spill_event": r"^Spill Events \d{4}$",
    "water_company": r"^Water Company$",
    "river_basin": r"^River Basin District$",
    "site_name": r"^Site Name$",
    "permit": r"^Permit Number$",
    "receiving_env": r"^Receiving Environment$",
    "duration": r"^Duration \(Hours\)$",
    "date": r"^(Date|Start Date|End Date)$",
    "count": r".*Count$",
    "total": r".*Total$",
}

# Known misspellings in column names.
MISSPELLINGS = {
    "receuving": "Receiving",
    "enviroment": "Environment",
    "permitt": "Permit",
    "compnay": "Company",
    "latitute": "Latitude",
    "longitute": "Longitude",
}


def missing_required(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    absent = missing_required(df, required)
    if absent:
        raise ValueError(f"missing required columns: {absent}")


def schema_contract(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """(column, role, present, filled_rows): which agreed columns exist and how many rows fill them."""
    agreed = [(c, "required") for c in required] + [(c, "optional") for c in optional]
    there = [c for c, _ in agreed if c in df.columns]
    single = df.agg(F.count("*").alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(there)])
    return long_rows(
        single,
        [
            {
                "column": F.lit(c),
                "role": F.lit(role),
                "present": F.lit(c in there),
                "filled_rows": F.col(f"n{there.index(c)}") if c in there else F.lit(0).cast("bigint"),
            }
            for c, role in agreed
        ],
    )


def header_table(df: DataFrame) -> DataFrame:
    """(column, filled_rows): the header of a table as rows."""
    single = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return long_rows(
        single, [{"column": F.lit(c), "filled_rows": F.col(f"n{i}")} for i, c in enumerate(df.columns)]
    )


def _matches(name: Column, pattern: str) -> Column:
    return name.rlike("(?i)^(?:" + pattern + ")")


def check_names(
    names: DataFrame, column: str = "column", patterns: Mapping[str, str] = NAME_PATTERNS
) -> DataFrame:
    """Adds ``matched_pattern``, the first kind whose pattern fits, or missing."""
    kinds = [F.when(_matches(quoted(column), p), F.lit(kind)) for kind, p in patterns.items()]
    return names.withColumn("matched_pattern", F.coalesce(*kinds))


def suggest_names(
    names: DataFrame, column: str = "column", misspellings: Mapping[str, str] = MISSPELLINGS
) -> DataFrame:
    """One row per known misspelling in a name, with the corrected name."""
    found = [
        F.struct(
            F.lit(typo).alias("typo"),
            F.regexp_replace(quoted(column), F.lit("(?i)" + typo), F.lit(fix)).alias("suggestion"),
        )
        for typo, fix in misspellings.items()
    ]
    return names.select("*", F.inline(F.array(*found))).filter(
        F.contains(F.lower(quoted(column)), F.col("typo"))
    )


def unmatched_patterns(names: DataFrame, patterns: Sequence[str], column: str = "column") -> DataFrame:
    """(pattern): the required patterns that no name fits."""
    single = names.agg(
        *[F.coalesce(F.bool_or(_matches(quoted(column), p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)]
    )
    rows = [{"pattern": F.lit(p), "found": F.col(f"p{i}")} for i, p in enumerate(patterns)]
    return long_rows(single, rows).filter(~F.col("found")).drop("found")


def select_by_type(df: DataFrame) -> DataFrame:
    """(column, kind, filled_rows) with kind numeric or other."""
    kinds = [(f.name, "numeric" if is_numeric(f.dataType) else "other") for f in df.schema]
    single = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, (c, _) in enumerate(kinds)])
    return long_rows(
        single,
        [
            {"column": F.lit(c), "kind": F.lit(kind), "filled_rows": F.col(f"n{i}")}
            for i, (c, kind) in enumerate(kinds)
        ],
    )


# Whole-number types from narrow to wide with their limits; a column must lie strictly inside.
_WHOLE = [("tinyint", 8), ("smallint", 16), ("int", 32)]


def narrow_decisions(df: DataFrame, low_cardinality: float = 0.5) -> DataFrame:
    """(column, current_type, decision): smaller types the data allows, and low-cardinality text.

    Distinct texts are counted as (column, digest) groups, so no task holds one column's whole value set.
    """
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    parts = []
    if whole:
        single = df.agg(
            *[F.min(quoted(c)).cast("bigint").alias(f"lo{i}") for i, c in enumerate(whole)],
            *[F.max(quoted(c)).cast("bigint").alias(f"hi{i}") for i, c in enumerate(whole)],
        )
        rows = []
        for i, c in enumerate(whole):
            decision = F.lit(types[c])
            for name, bits in reversed(_WHOLE):
                limit = 2 ** (bits - 1)
                fits = (F.col(f"lo{i}") > -limit) & (F.col(f"hi{i}") < limit - 1)
                decision = F.when(fits, F.lit(name)).otherwise(decision)
            rows.append({"column": F.lit(c), "current_type": F.lit(types[c]), "decision": decision})
        parts.append(long_rows(single, rows))
    if texts:
        share = F.count("digest") / F.sum("n")
        kind = F.when(share < low_cardinality, F.lit("low_cardinality")).otherwise(F.lit("string"))
        parts.append(
            digest_counts(df, texts)
            .groupBy("column")
            .agg(kind.alias("decision"))
            .select("column", F.lit("string").alias("current_type"), "decision")
        )
    if doubles:
        single = df.agg(F.count("*").alias("rows"))
        parts.append(
            long_rows(
                single,
                [{"column": F.lit(c), "current_type": F.lit("double"), "decision": F.lit("float")} for c in doubles],
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def narrow_types(df: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Cast number columns to the decided types; text keeps its type, the file format encodes it."""
    decisions = narrow_decisions(df) if decisions is None else decisions
    chosen = {r["column"]: r["decision"] for r in decisions.collect()}  # one row per column
    numeric = {f.name for f in df.schema if is_numeric(f.dataType)}
    return df.withColumns({c: quoted(c).cast(d) for c, d in chosen.items() if c in numeric})


