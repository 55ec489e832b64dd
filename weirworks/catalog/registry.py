"""Name, Spark query and, where SQL can express it, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import quoted

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, because sums of doubles differ in the last digits between engines."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.round(quoted(c).cast("double"), digits).alias(c) if c in doubles else quoted(c) for c in df.columns]
    )


def r(expression: str, name: str, digits: int = 4) -> str:
    return f'round(CAST({expression} AS DOUBLE), {digits}) AS "{name}"'


def bucket_sql(key: str, buckets: int, seed: int = 42) -> str:
    """The number below ``buckets`` that splits, folds and samples give a key."""
    return f"(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 8) AS BIGINT) % {buckets})"


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def as_is(columns: Sequence[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)
