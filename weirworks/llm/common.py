"""Helpers of the corpus operators: columns by name, shipped code, bounded Arrow batches, scratch tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds in one Arrow batch.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and bound the batches that Python workers get by bytes and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="weirworks-code-"), "weirworks_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, str(path.relative_to(package.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(application)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: ``pick(docs, id="doc_id")``.

    Extra columns of the input, whatever their names, never meet the operator's own columns.
    """
    return df.select(*[df[quoted(source)].alias(name) for name, source in columns.items()])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_of(column: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def wide_hash(column: Column | str) -> Column:
    """128-bit digest as 16 bytes: two different values share one with a chance of about 1e-15 at 10^11 values."""
    return F.unhex(F.md5(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if columns is None else df.select(*columns)
