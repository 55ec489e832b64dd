from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weirworks.operators.profile import categorical_profile, duplicate_count, missing_overall, numeric_profile, score_dataset
from weirworks.plans import cleaning, reports

COLUMNS = "id int, lat double, y1 string, y2 double, y3 double, name string, place string"
RULES = cleaning.CleaningRules(
    required=("lat",),
    bounds={"lat": (0.0, 10.0)},
    periods=("y1", "y2", "y3", "y4"),
    texts=("name", "place"),
    max_missing_share=0.2,
    min_periods=2,
)
ROWS = [
    (1, 5.0, "1", 2.0, 3.0, "a", "p"),
    (1, 5.0, "1", 2.0, 3.0, " a ", "p"),  # a duplicate only after trimming
    (2, None, "1", 2.0, 3.0, "a", "p"),  # no coordinate
    (3, 11.0, "1", 2.0, 3.0, "a", "p"),  # out of range
    (4, 5.0, "x", None, 3.0, "a", "p"),  # one valid period left
    (5, 5.0, "1", 2.0, 3.0, "  ", ""),  # no text
    (6, 5.0, "1", 2.0, None, "a", None),  # two of seven missing
    (7, 5.0, "1", 2.0, None, "a", "p"),  # one of seven missing
    (7, 5.0, "1", 2.0, None, "a", "p"),  # an exact copy
]


def frame(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_each_rule_removes_its_rows(spark):
    cleaned = cleaning.clean(frame(spark), RULES)
    assert sorted(r.id for r in cleaned.collect()) == [1, 7]
    removed = {r.rule: r.rows_removed for r in cleaning.removal_breakdown(frame(spark), RULES).collect()}
    assert removed == {
        "missing_coordinates": 1,
        "invalid_lat": 1,
        "short_series": 1,
        "empty_text": 1,
        "duplicates": 2,
        "sparse_row": 1,
    }


@pytest.mark.parametrize("name", ["strict_default", "relaxed_text", "spill_imputation", "aggressive_outliers"])
def test_removals_and_figures_add_up(spark, name):
    rules = cleaning.strategy_rules(RULES)[name]
    df = frame(spark)
    cleaned = cleaning.clean(df, rules)
    figures = cleaning.cleaning_metrics(df, rules).first()
    removed = sum(r.rows_removed for r in cleaning.removal_breakdown(df, rules).collect())
    assert figures.rows_in == len(ROWS)
    assert figures.rows_out == cleaned.count() == len(ROWS) - removed
    assert figures.initial_missing_percent == pytest.approx(missing_overall(df).first().missing_percent)
    assert figures.final_missing_percent == pytest.approx(missing_overall(cleaned).first().missing_percent)
    before, after = (duplicate_count(f).first().duplicate_rows for f in (df, cleaned))
    assert figures.duplicate_reduction == before - after


def test_all_strategies_from_one_scan_equal_each_alone(spark, capfd):
    strategies = cleaning.strategy_rules(RULES) | {
        "keep_copies": replace(RULES, deduplicate=False, blank_outliers=False),
        "text_fill": replace(RULES, fill=True, fill_value="?"),
        "other_bounds": replace(RULES, bounds={"lat": (0.0, 6.0)}),
    }
    df = frame(spark).unionAll(frame(spark).limit(3)).repartition(3)
    together = {r.strategy: r for r in cleaning.strategy_summary(df, strategies).collect()}
    removed = cleaning.strategy_removals(df, strategies)
    found = sorted(map(tuple, removed.collect()))
    assert list(together) and set(together) == set(strategies)
    for name, rules in strategies.items():
        alone = cleaning.cleaning_metrics(df, rules).first()
        assert tuple(together[name])[1:] == tuple(alone)
        cleaned = cleaning.clean(df, rules)
        assert together[name].rows_out == cleaned.count()
        assert together[name].final_missing_percent == pytest.approx(missing_overall(cleaned).first().missing_percent)
        steps = sorted((name, r.step, r.rule, r.rows_removed) for r in cleaning.removal_breakdown(df, rules).collect())
        assert [row for row in found if row[0] == name] == steps
    cleaning.strategy_removals(df, strategies).explain("simple")
    plan = capfd.readouterr().out
    assert 1 <= plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 2 and plan.count("Exchange hashpartitioning(raw") == 1  # the two halves of the union, once each


def test_strategies_on_empty_and_clashing_tables(spark):
    strategies = cleaning.strategy_rules(RULES)
    empty = frame(spark).limit(0)
    assert sorted((r.strategy, r.rows_in, r.rows_out) for r in cleaning.strategy_summary(empty, strategies).collect()) == sorted((n, 0, 0) for n in strategies)
    assert cleaning.strategy_removals(empty, strategies).count() == 0
    odd = frame(spark).withColumns({c: F.lit(1) for c in ("at", "row", "rule", "copies", "missing", "strategy", "vector")})
    assert cleaning.strategy_summary(odd, strategies).count() == len(strategies)
    idle = cleaning.CleaningRules(strict=False, deduplicate=False, fill=True)
    assert cleaning.strategy_removals(frame(spark), {"idle": idle}).count() == 0
    with pytest.raises(ValueError, match="__audit_raw"):
        cleaning.cleaning_metrics(frame(spark).withColumn("__audit_raw", F.lit(1)), RULES)


def test_duplicates_can_stay(spark):
    rules = replace(RULES, deduplicate=False)
    figures = cleaning.cleaning_metrics(frame(spark), rules).first()
    assert figures.rows_out == cleaning.clean(frame(spark), rules).count() == 4
    assert figures.duplicate_reduction == 1 - 2  # trimming makes one more pair of equal rows


def test_outliers_go_before_the_period_count(spark):
    rows = [(i, 5.0, str(i % 3), 1.0, None, "a", "p") for i in range(60)] + [(99, 5.0, "9999", 1.0, None, "a", "p")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert 99 not in [r.id for r in cleaning.clean(df, RULES).collect()]
    kept = cleaning.clean(df, replace(RULES, blank_outliers=False))
    assert 99 in [r.id for r in kept.collect()]


def test_strict_mode_needs_required_columns(spark):
    with pytest.raises(ValueError, match="lat"):
        cleaning.clean(frame(spark).drop("lat"), RULES)
    assert cleaning.clean(frame(spark).drop("lat"), replace(RULES, strict=False)).count() == 4


def test_settings_overlay():
    rules = cleaning.rules_from_settings(RULES, {"lat_min": 4.0, "outlier_threshold": 2.0, "missing_threshold": 0.5})
    assert rules.bounds == {"lat": (4.0, 10.0)} and rules.outlier_z == 2.0 and rules.max_missing_share == 0.5


def test_same_result_on_any_partitioning(spark):
    one = cleaning.clean(frame(spark).coalesce(1), RULES).collect()
    many = cleaning.clean(frame(spark).repartition(8), RULES).collect()
    assert sorted(one) == sorted(many)


def test_job_writes_everything(spark, tmp_path):
    paths = cleaning.cleaning_job(frame(spark), RULES, str(tmp_path))
    assert spark.read.parquet(paths["backup"]).count() == len(ROWS)
    assert spark.read.parquet(paths["cleaned"]).count() == 2
    assert spark.read.json(paths["metrics"]).first().rows_removed == 7
    assert spark.read.json(paths["score"]).count() == 1


def test_profiles(spark):
    df = frame(spark)
    top = {r["column"]: (r.top_value, r.top_frequency, r.unique_count) for r in categorical_profile(df).collect()}
    assert top["name"] == ("a", 7, 3) and top["y1"] == ("1", 8, 2)
    numbers = {r["column"]: r for r in numeric_profile(df, ["lat", "y3"]).collect()}
    assert numbers["lat"].missing_count == 1 and numbers["y3"].median == 3.0
    assert 0 <= score_dataset(df).first().quality_score <= 100


def test_mode_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    assert categorical_profile(df).first().top_value == "a"


def test_validation(spark):
    found = {(r.severity, r.check, r.item) for r in reports.validation_report(frame(spark), ["nope"]).collect()}
    assert ("error", "missing_required", "nope") in found and ("warning", "duplicate_rows", "all") in found
    empty = frame(spark).limit(0)
    assert ("error", "too_few_rows", "all") in {(r.severity, r.check, r.item) for r in reports.validation_report(empty).collect()}
    with pytest.raises(ValueError, match="too_few_rows"):
        reports.require_valid(empty)
