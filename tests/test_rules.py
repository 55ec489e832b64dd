import pytest
from pyspark.sql import functions as F

from weirworks.functions.columns import (
    WHITESPACE,
    categorical_score,
    dataset_score,
    first_last_delta,
    numeric_score,
    row_mean,
    strip,
    to_number,
    trend_label,
)
from weirworks.operators import groups, profile, rules, schema
from weirworks.sources.tables import blank_sentinels, from_rows


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_missing_is_outside_a_range_but_dropped_first_when_filtering(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "x double")
    assert one(rules.range_violations(df, {"x": (0, 5)}))["invalid_rows"] == 2
    assert [r.x for r in rules.range_filter(df, {"x": (0, 5)}).collect()] == [1.0]


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert rules.blank_nan(df).filter("x is null").count() == 1


def test_range_ends_are_inside(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,)], "x double")
    assert rules.range_filter(df, {"x": (0, 5)}).count() == 2


def test_outliers_are_blanked_and_rows_stay(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(100)] + [(1000.0,)], "x double")
    cleaned = rules.null_outliers(df, ["x"], 3.0)
    assert cleaned.count() == 101 and cleaned.filter("x is null").count() == 1


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert rules.null_outliers(df, ["x"]).filter("x is null").count() == 0


def test_strip_removes_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("\t  a b  \n",), ("　 \r",), (None,)], "x string")
    assert [r[0] for r in df.select(strip(F.col("x"))).collect()] == ["a b", None, None]
    assert " " in WHITESPACE and " " in WHITESPACE


def test_sentinels_in_every_text_column(spark):
    df = spark.createDataFrame([("TBC", 1, "a"), ("b", 2, "Unknown"), ("null", 3, "")], "x string, n int, y string")
    assert [tuple(r) for r in blank_sentinels(df).collect()] == [(None, 1, "a"), ("b", 2, None), (None, 3, None)]


def test_unparseable_text_is_missing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("nan",), (" 2 ",)], "x string")
    assert [r[0] for r in df.select(to_number(F.col("x"))).collect()] == [1.5, None, None, 2.0]


def test_sparse_rows_need_more_than_the_threshold(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, None), (1, 1, None, None)], "a int, b int, c int, d int")
    assert rules.drop_sparse_rows(df, 0.25).count() == 2


def test_fill_constant_skips_text(spark):
    df = spark.createDataFrame([(None, None)], "a int, t string")
    assert tuple(one(rules.fill_constant(df, 0))) == (0, None)
    assert tuple(one(rules.fill_constant(df, "none"))) == (None, "none")


def test_fill_median_and_cap(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (11.0,)], "x double")
    assert sorted(r.x for r in rules.fill_median(df).collect()) == [1.0, 3.0, 3.0, 11.0]
    assert sorted(r.x for r in rules.percentile_cap(df, "x", 50).collect()) == [1.0, 3.0]


def test_row_measures(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None)], "y2 double, y1 double, y3 double")
    names = ["y2", "y1", "y3"]
    got = df.select(row_mean(names), first_last_delta(names)).collect()
    assert tuple(got[0]) == (2.5, 4.0) and tuple(got[1]) == (None, 0.0)
    assert df.select(row_mean([])).first()[0] == 0.0
    with pytest.raises(ValueError):
        first_last_delta(["y1"])
    labels = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (None,)], "d double").select(trend_label(F.col("d")))
    assert [r[0] for r in labels.collect()] == ["improving", "stable", "worsening", None]


def test_scores_by_formula(spark):
    single = spark.range(1)
    true = F.lit(True)
    numeric = single.select(numeric_score(F.lit(5.0), F.lit(1.0), true)).first()[0]
    text = single.select(categorical_score(F.lit(2.0), F.lit(1.0), true)).first()[0]
    assert numeric == pytest.approx(97.2) and text == pytest.approx(99.0)
    both = single.select(dataset_score(F.lit((numeric + text) / 2), F.lit(3.5))).first()[0]
    assert both == pytest.approx(97.05)
    assert single.select(categorical_score(F.lit(0.0), F.lit(95.0), true)).first()[0] == 80.0
    assert single.select(numeric_score(F.lit(100.0), F.lit(100.0), F.lit(False))).first()[0] == 0.0
    assert single.select(dataset_score(F.lit(None).cast("double"), F.lit(0.0))).first()[0] == 0.0


def test_input_gate(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    with pytest.raises(ValueError, match="required_columns"):
        rules.require_input(df, ["a", "z"])
    with pytest.raises(ValueError, match="complete_rows"):
        rules.require_input(df, ["a", "b"], drop_incomplete=False)
    with pytest.raises(ValueError, match="min_rows"):
        rules.require_input(df, ["a", "b"], min_rows=2)
    assert rules.require_input(df, ["a", "b"]).count() == 1


def test_stand_in_features(spark):
    df = spark.createDataFrame([(9, 1.0, 2.0, "x", 3.0, 4.0)], "id int, a double, b double, t string, c double, d double")
    assert rules.project_features(df, ["zz"], "yy", ["id"], 3).columns == ["id", "b", "c", "d", "a"]
    assert rules.project_features(df, ["a"], "b", ["id"]).columns == ["id", "a", "b"]


def test_names(spark):
    names = spark.createDataFrame(
        [("Latitude",), ("Receuving Enviroment",), ("water company",), ("Spill Events 2023",), ("Row Count",)], "column string"
    )
    kinds = {r["column"]: r["matched_pattern"] for r in schema.check_names(names).collect()}
    assert kinds == {
        "Latitude": "coordinate",
        "Receuving Enviroment": None,
        "water company": "water_company",
        "Spill Events 2023": "spill_event",
        "Row Count": "count",
    }
    fixes = {r["suggestion"] for r in schema.suggest_names(names).collect()}
    assert fixes == {"Receiving Enviroment", "Receuving Environment"}
    missing = schema.unmatched_patterns(names, ["^Latitude$", "^Longitude$"]).collect()
    assert [r["pattern"] for r in missing] == ["^Longitude$"]


def test_narrow_types_strictly_inside_limits(spark):
    df = spark.createDataFrame([(126, 127, 40000, 1.0, "a")] * 3, "a bigint, b bigint, c bigint, d double, t string")
    decided = {r["column"]: r["decision"] for r in schema.narrow_decisions(df).collect()}
    assert decided == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float", "t": "low_cardinality"}
    types = dict(schema.narrow_types(df).dtypes)
    assert types == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float", "t": "string"}


def test_flags(spark):
    df = spark.createDataFrame([("Yes", "x"), ("no", "y"), (None, "z"), ("?", "w")], "`A Flag` string, t string")
    assert [r["A Flag"] for r in rules.flags_to_int(df).collect()] == [1, 0, None, None]


def test_rows_in_memory(spark):
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = from_rows(spark, [{"a": i, "b": "x"} for i in range(5)] + [{"a": 9}], shape)
    assert df.count() == 6 and df.filter("b is null").count() == 1 and df.rdd.getNumPartitions() == 1


def test_absent_features_are_an_error_unless_stand_ins_are_allowed(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    with pytest.raises(ValueError, match="zz"):
        rules.project_features(df, ["zz"], "a", ["id"])
    assert rules.project_features(df, ["zz"], "a", ["id"], stand_ins=1).columns == ["id", "b", "a"]


def test_rename_and_round(spark):
    df = spark.createDataFrame([(1, 0.125, "a"), (2, None, None)], "k int, `a mean` double, t string")
    got = groups.rename_round(df, {"a mean": "Mean", "absent": "x"})
    assert got.columns == ["k", "Mean", "t"]
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, 0.13, "a"), (2, None, None)]


def test_long_modes_are_told_apart_by_their_whole_text(spark):
    long = "x" * profile.HEAD
    texts = [long + "b"] * 3 + [long + "a"] * 3 + [long + "0"] * 2 + ["y"] * 3 + [None]
    other = [long] * 4 + [long + "z"] * 4 + ["short", "", None, None]
    df = spark.createDataFrame(list(zip(texts, other)), "`the text` string, o string")
    got = {r["column"]: r for r in profile.categorical_profile(df).collect()}
    row = got["the text"]
    assert (row["top_value"], row["top_frequency"], row["unique_count"], row["count"]) == (long + "a", 3, 4, 11)
    assert (got["o"]["top_value"], got["o"]["top_frequency"], got["o"]["missing_count"]) == (long, 4, 2)


def test_text_profile_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert profile.categorical_profile(empty).collect() == []
    nulls = spark.createDataFrame([(None,), (None,)], "a string")
    row = one(profile.categorical_profile(nulls))
    assert (row["count"], row["unique_count"], row["top_value"], row["top_frequency"]) == (0, 0, None, 0)
    # Every text once: the smallest is the mode, whatever its length.
    unique = spark.createDataFrame([("p" * 200 + str(i),) for i in range(20)], "a string")
    assert one(profile.categorical_profile(unique))["top_value"] == "p" * 200 + "0"
