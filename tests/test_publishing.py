"""Versioned publishing: readers see all of one run or all of another, never a mixture or a half."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weirworks.plans import cleaning
from weirworks.sources import publishing
from weirworks.sources.sinks import write_table


def values(df):
    return sorted(row[0] for row in df.collect())


def test_readers_see_the_last_complete_run(spark, tmp_path):
    base = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publishing.current_tables(spark, base)
    publishing.publish_tables({"a": spark.range(3), "b": spark.range(1)}, base)
    held = publishing.read_published(spark, base, "a")
    publishing.publish_tables({"a": spark.range(5), "b": spark.range(2)}, base, {"b": "json"})
    assert values(publishing.read_published(spark, base, "a")) == [0, 1, 2, 3, 4]
    assert values(publishing.read_published(spark, base, "b", file_format="json")) == [0, 1]
    assert values(publishing.read_published(spark, base, "a", back=1)) == [0, 1, 2]
    assert values(held) == [0, 1, 2]  # a frame opened before keeps its version


def test_a_run_that_dies_leaves_the_old_tables(spark, tmp_path):
    base = str(tmp_path / "out")
    publishing.publish_tables({"a": spark.range(3), "b": spark.range(3)}, base)
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        publishing.publish_tables({"a": spark.range(9), "b": broken}, base)
    assert values(publishing.read_published(spark, base, "a")) == [0, 1, 2]
    # A manifest that was cut off counts as absent, and its number is not used again.
    Path(base, "_manifests", "000000000002").write_text('{"version": "version=')
    assert values(publishing.read_published(spark, base, "b")) == [0, 1, 2]
    publishing.publish_tables({"a": spark.range(1), "b": spark.range(1)}, base)
    assert Path(base, "_manifests", "000000000003").exists()
    assert values(publishing.read_published(spark, base, "a")) == [0]


def test_old_versions_go_and_unfinished_ones_stay(spark, tmp_path):
    base = str(tmp_path / "out")
    for n in (1, 2, 3):
        publishing.publish_tables({"a": spark.range(n)}, base)
    unfinished = publishing.new_version(base)
    path = write_table(spark.range(8), f"{unfinished}/a")
    assert len(publishing.retire_versions(spark, base, keep=2)) == 1
    assert values(publishing.read_published(spark, base, "a", back=1)) == [0, 1]
    with pytest.raises(FileNotFoundError):
        publishing.current_tables(spark, base, back=2)
    assert publishing.commit_version(spark, base, unfinished, {"a": path}) == 4
    assert publishing.read_published(spark, base, "a").count() == 8
    with pytest.raises(ValueError, match="outside"):
        publishing.commit_version(spark, base, unfinished, {"a": str(tmp_path / "elsewhere")})
    with pytest.raises(ValueError):
        publishing.retire_versions(spark, base, keep=0)


def test_cleaning_job_publishes_all_its_tables_together(spark, tmp_path):
    rules = cleaning.CleaningRules(bounds={"x": (0.0, 9.0)})
    base = str(tmp_path / "job")
    cleaning.cleaning_job(spark.createDataFrame([(1, 1.0), (2, 99.0)], "id long, x double"), rules, base)
    cleaning.cleaning_job(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id long, x double"), rules, base)
    tables = publishing.current_tables(spark, base)
    assert {"backup", "cleaned", "removals", "metrics", "column_scores", "score"} == set(tables)
    assert values(publishing.read_published(spark, base, "cleaned").select("id")) == [1, 2]
    assert values(publishing.read_published(spark, base, "cleaned", back=1).select("id")) == [1]
    assert publishing.read_published(spark, base, "metrics", file_format="json").first().rows_removed == 1
