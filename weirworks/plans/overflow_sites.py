"""The jobs with the columns and thresholds of the published sewage-overflow table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weirworks.functions.columns import quoted, row_mean
from weirworks.operators.regression import train_regressor
from weirworks.operators.rules import drop_missing
from weirworks.plans.cleaning import CleaningRules, cleaning_job, rules_from_settings
from weirworks.plans.modelling import cluster_workflow
from weirworks.plans.reports import analyse
from weirworks.session import materialised
from weirworks.sources.tables import scan_csv

# Text columns of the published table.
TEXT_COLUMNS = (
    "ID",
    "Water company",
    "Site name",
    "Receiving Environment",
    "River Basin District",
    "Management Catchment",
    "Local Authority",
    "Water Body",
    "Bathing Water Discharge Flag",
    "Shellfish Water Discharge Flag",
    "Ecological High Priority Site Flag",
    "Marine Protected Area Discharge Flag",
    "Non-bathing Priority Site Flag",
    "Sewage Reduction Plan Targets Met Flag",
    "Rainfall Improvement Target Delivery Flag",
    "Improvements List",
    "Baseline Less Than Target",
    "Requires No Improvement",
)

# Cleaning defaults.
REQUIRED = ("Latitude", "Longitude", "Water company", "River Basin District")
OPTIONAL = ("Site Name", "Receiving Environment", "Permit Number")
CHECKED_TEXT = ("Water company", "River Basin District", "Site Name", "Receiving Environment")
SPILL_YEARS = tuple(f"Spill Events {year}" for year in range(2020, 2026))
WORLD_BOUNDS = {"Latitude": (-90.0, 90.0), "Longitude": (-180.0, 180.0)}

# The settings overlay with bounds for the United Kingdom.
UK_SETTINGS = {
    "Latitude_min": 49.0,
    "Latitude_max": 61.0,
    "Longitude_min": -11.0,
    "Longitude_max": 2.0,
    "missing_threshold": 0.1,
    "outlier_threshold": 3.0,
    "strict_validation": True,
}

# Model and cluster columns.
TARGET = "Predicted Annual Spill Frequence Post Scheme"
FEATURES = ("Spill Events 2020", "Spill Events 2021", "Spill Events 2022", "Latitude", "Longitude")
CLUSTER_OPTIONAL = (
    "Spill Trend",
    TARGET,
    "Ecological High Priority Site Flag",
    "Non-bathing Priority Site Flag",
    "Bathing Water Discharge Flag",
    "Shellfish Water Discharge Flag",
)

DEFAULT_RULES = CleaningRules(required=REQUIRED, bounds=WORLD_BOUNDS, periods=SPILL_YEARS, texts=CHECKED_TEXT)


def table_schema(names: list[str]) -> T.StructType:
    """Text for the known text columns, double for every other column of a header."""
    kind = {name: T.StringType() for name in TEXT_COLUMNS}
    return T.StructType([T.StructField(name, kind.get(name, T.DoubleType())) for name in names])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table with types from its header; only the first line is looked at for the names."""
    header = spark.read.option("header", True).csv(path, inferSchema=False).columns
    return scan_csv(spark, path, table_schema(header))


def spill_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "Spill Events" in c]


def clean_table(
    spark: SparkSession, path: str, base: str, rules: CleaningRules = DEFAULT_RULES, settings: dict | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """Read, clean and write a table with its report; ``settings`` lays thresholds such as UK_SETTINGS over the rules."""
    rules = rules if settings is None else rules_from_settings(rules, settings)
    paths = cleaning_job(materialised(read_table(spark, path), "table"), rules, base)
    return spark.read.parquet(paths["cleaned"]), paths


def analyse_table(df: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    company = "Water Company" if "Water Company" in df.columns else "Water company"
    return analyse(df, company, "River Basin District", spill_columns(df), top_n)


def train_table(df: DataFrame, key: str = "ID", trees: int = 100) -> tuple[PipelineModel, DataFrame]:
    complete = drop_missing(df, [*FEATURES, TARGET])
    return train_regressor(complete, key, FEATURES, TARGET, trees=trees)


def cluster_table(df: DataFrame, key: str = "ID", **options) -> dict[str, DataFrame]:
    """Clusters over coordinates, mean yearly spills and whichever optional columns there are."""
    measured = df.withColumn("Avg_Annual_Spills", row_mean(spill_columns(df)))
    kept = [c for c in CLUSTER_OPTIONAL if c in df.columns]
    rows = measured.select(*map(quoted, dict.fromkeys([key, "Latitude", "Longitude", "Avg_Annual_Spills", *kept])))
    return cluster_workflow(rows, key, ["Latitude", "Longitude", "Avg_Annual_Spills"], kept, **options)
