"""Table sources: CSV with an explicit schema, column selection, block size, rows in memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import DEFAULT_MISSING, SENTINELS, is_numeric, quoted, text_names, to_number
from weirworks.sources.csv_files import by_header, quoted_rows

BROKEN = "_broken_row"
MISSING_STRINGS = tuple(dict.fromkeys([*SENTINELS, *DEFAULT_MISSING]))


def blank_sentinels(df: DataFrame, strings: Sequence[str] = MISSING_STRINGS) -> DataFrame:
    """Every text column: the listed strings become missing."""
    listed = [F.lit(s) for s in strings]
    return df.withColumns({c: F.when(~quoted(c).isin(listed), quoted(c)) for c in text_names(df)})


def _typed(name: str, data_type: T.DataType) -> Column:
    """Whole numbers go through double, as a reader that expects missing values does."""
    if isinstance(data_type, T.StringType):
        return quoted(name)
    if is_numeric(data_type):
        return to_number(quoted(name)).try_cast(data_type).alias(name)
    return quoted(name).try_cast(data_type).alias(name)


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    required: Sequence[str] = (),
    strings: Sequence[str] = MISSING_STRINGS,
    broken: str = "fail",
    multi_line: bool = False,
) -> DataFrame:
    """Read a CSV with a header: text scan, listed strings to missing, then one cast per column.

    Columns are found by the name in the header, in whatever order each file has them; every file must have the wanted ones. ``columns`` prunes the result; every
    required column must be among them. ``broken`` says what happens to rows with more or fewer fields than the header:
    "fail" ends the job that meets one, "drop" leaves them out, "keep" takes the fields that are there. The first two have to
    parse all columns of the file, "keep" only those that are asked for. ``broken_rows`` lists such rows.
    ``multi_line`` allows line breaks within quotes; such files are read in blocks too, at the price of a pass that counts quotes.
    """
    if broken not in ("fail", "drop", "keep"):
        raise ValueError(f"unknown choice for broken rows: {broken}")
    absent = set(required) - set(schema.names if columns is None else columns)
    if absent:
        raise ValueError(f"required columns must be selected: {sorted(absent)}")
    wanted = schema.names if columns is None else list(columns)
    parts = []
    for raw in _text_scans(spark, path, multi_line, broken != "keep"):
        missing = [n for n in wanted if n not in raw.columns]
        if missing:
            raise ValueError(f"columns absent from the header: {missing}")
        if broken == "drop":
            raw = raw.filter(~_is_broken(raw))
        elif broken == "fail":
            message = F.concat(F.lit("a row with the wrong number of fields: "), quoted(BROKEN))
            raw = raw.filter(F.when(_is_broken(raw), F.raise_error(message).cast("boolean")).otherwise(True))
        parts.append(raw.select(*map(quoted, wanted)))
    blanked = blank_sentinels(reduce(DataFrame.unionAll, parts), strings)
    return blanked.select(*[_typed(n, schema[n].dataType) for n in wanted])


def _text_scans(spark: SparkSession, path: str, multi_line: bool, watched: bool = True) -> list[DataFrame]:
    """One scan for each different header: its columns as text and, if watched, the whole row where its fields do not fit."""
    scans = []
    for names, files in by_header(spark, path):
        text_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *[BROKEN] * watched]])
        options = {"escape": '"', "columnNameOfCorruptRecord": BROKEN, "mode": "PERMISSIVE"}
        if multi_line:
            ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in text_schema.names)
            parsed = quoted_rows(spark, files).select(F.from_csv("row", ddl, options).alias("r"))
            scans.append(parsed.select("r.*"))
        else:
            scans.append(spark.read.schema(text_schema).csv(files, header=True, **options))
    return scans


def _is_broken(raw: DataFrame) -> Column:
    """Only a scan of all columns sees how many fields a row has, so the test asks for all of them."""
    whole = F.concat_ws("", *[F.coalesce(quoted(c), F.lit("")) for c in raw.columns])
    return (F.length(whole) >= 0) & (F.coalesce(F.length(quoted(BROKEN)), F.lit(0)) > 0)


def broken_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(row): the rows whose number of fields is not that of the header."""
    scans = _text_scans(spark, path, multi_line)
    return reduce(DataFrame.unionAll, [raw.filter(_is_broken(raw)).select(quoted(BROKEN).alias("row")) for raw in scans])


def scan_split(
    spark: SparkSession, path: str, schema: T.StructType, block_bytes: int = 64 * 1024 * 1024, **options: Any
) -> DataFrame:
    """``scan_csv`` with its own block size.

    The block size is a session setting, so the scan gets a sibling session and the caller's stays as it is.
    """
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    return scan_csv(sibling, path, schema, **options)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*map(quoted, columns))


def from_rows(
    spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """Rows in memory (dictionaries) as a distributed frame, one partition per 10 000 rows."""
    tuples = [tuple(row.get(name) for name in schema.names) for row in rows]
    count = partitions or max(1, len(tuples) // 10000)
    return spark.createDataFrame(tuples, schema).repartition(count)
