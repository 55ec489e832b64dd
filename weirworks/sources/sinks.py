"""Sinks: cleaned tables, snapshots of the input, reports and fitted models."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, file_format: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write one file per task; never funnelled into a single file."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "csv":
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, escape='"', **blanks).csv(path)
    else:
        writer.format(file_format).save(path)
    return path


def write_snapshot(df: DataFrame, base: str, stamp: str | None = None) -> str:
    """Copy of the input before cleaning, below a timestamped folder."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    return write_table(df, f"{base.rstrip('/')}/backup_ts={stamp}")


def write_report(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """One JSON folder per report table."""
    return {name: write_table(df, f"{base.rstrip('/')}/{name}", "json") for name, df in tables.items()}


def save_model(model: Model, path: str) -> str:
    """Any fitted model: a pipeline, one of Spark's, or one of ``operators.ensembles``."""
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> Model:
    """A stored model of the kind that was saved; a path without one raises FileNotFoundError."""
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(context._jsc.hadoopConfiguration()).exists(location):
        raise FileNotFoundError(f"no model at {path}")
    return DefaultParamsReader.loadParamsInstance(path, spark)
