import numpy as np
import pytest
from pyspark.sql import functions as F

from weirworks.operators import quantiles
from weirworks.operators.quantiles import approximate_quantiles, exact_quantiles, long_values

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def rows(spark):
    rng = np.random.default_rng(7)
    n = 3000
    hot = np.where(rng.random(n) < 0.34, 5.0, rng.lognormal(3, 4, n))  # a third of all rows share one value
    data = [
        (int(k), float(a), float(b), None if i % 7 == 0 else float(c))
        for i, (k, a, b, c) in enumerate(
            zip(rng.integers(0, 4, n), hot, rng.normal(0, 1e-6, n), rng.uniform(-1e9, 1e9, n))
        )
    ]
    return spark.createDataFrame(data, "k int, a double, b double, c double")


def found(df):
    return {tuple(row)[:-1]: row["value"] for row in df.collect()}


@pytest.mark.parametrize(
    "limits",
    [{}, {"large_bucket": 0}, {"small_targets": 0}, {"small_targets": 0, "large_bucket": 40}],
    ids=["plain", "split", "distributed", "distributed split"],
)
def test_matches_numpy_on_every_path(spark, limits):
    df = rows(spark)
    pandas = df.toPandas()
    got = found(exact_quantiles(df, ["a", "b", "c"], PROBS, **limits))
    assert len(got) == 3 * len(PROBS)
    for (column, prob), value in got.items():
        assert value == pytest.approx(np.nanquantile(pandas[column], prob), rel=1e-12, abs=1e-18)


@pytest.mark.parametrize("limits", [{}, {"small_targets": 3}], ids=["broadcast", "distributed"])
def test_per_group(spark, limits):
    df = rows(spark)
    pandas = df.toPandas()
    got = found(exact_quantiles(df, ["a"], [0.5], ["k"], **limits))
    for k in range(4):
        assert got[(k, "a", 0.5)] == pytest.approx(np.median(pandas[pandas.k == k].a), rel=1e-12)


def test_crowded_cell_with_a_stray_value(spark, monkeypatch):
    # All values of one doubling step but one lie within a billionth; the stray one stretches the cell.
    rng = np.random.default_rng(3)
    near = 1.0 + rng.integers(0, 2000, 6000) * 1e-12
    values = np.concatenate([near, np.full(3000, 1.0 + 5e-10), [1.0001]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    seen = []
    refined = quantiles._refined

    def noted(*arguments):
        rows, ranks, split = refined(*arguments)
        cell = [name for name in rows.columns if name not in ("value", "n", "before")]
        spread = rows.groupBy(*cell).agg(F.count("*").alias("size"), F.countDistinct("value").alias("values"))
        seen.append((split, spread.filter("size > 50 and values > 1").count()))
        return rows, ranks, split

    monkeypatch.setattr(quantiles, "_refined", noted)
    got = found(exact_quantiles(df, ["x"], PROBS, large_bucket=50))
    for (_, prob), value in got.items():
        assert value == pytest.approx(np.quantile(values, prob), rel=1e-15)
    assert len(seen) > 1 and seen[-1] == (False, 0)


def test_split_keeps_groups_apart(spark):
    df = rows(spark)
    pandas = df.toPandas()
    got = found(exact_quantiles(df, ["c"], [0.2, 0.5], ["k"], large_bucket=10))
    for (k, _, prob), value in got.items():
        assert value == pytest.approx(np.nanquantile(pandas[pandas.k == k].c, prob), rel=1e-12)


def test_odd_values_in_split_cells(spark):
    data = [(v,) for v in (0.0, -0.0, float("inf"), float("inf"), float("-inf"), 1e308, 9e307, None)]
    df = spark.createDataFrame(data, "x double")
    plain, split = (found(exact_quantiles(df, ["x"], [0.0, 0.3, 0.5, 0.9], large_bucket=n)) for n in (100, 0))
    assert plain == split and len(plain) == 4


def test_odd_values(spark):
    df = spark.createDataFrame(
        [(1.0,), (float("nan"),), (None,), (float("inf"),), (float("-inf"),), (0.0,)], "x double"
    )
    assert long_values(df, ["x"]).count() == 4
    got = found(exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]))
    assert got[("x", 0.0)] == float("-inf") and got[("x", 0.5)] == 0.5 and got[("x", 1.0)] == float("inf")


def test_empty_column_has_no_rows(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).count() == 0


def test_independent_of_partitions(spark):
    df = rows(spark)
    one = found(exact_quantiles(df.coalesce(1), ["a", "c"], [0.3, 0.6]))
    many = found(exact_quantiles(df.repartition(8), ["a", "c"], [0.3, 0.6]))
    assert one == many


def test_names_with_blanks(spark):
    df = spark.range(5).select(F.col("id").alias("Spill Events 2020"), F.lit("x").alias("the key"))
    got = found(exact_quantiles(df, ["Spill Events 2020"], [0.5], ["the key"]))
    assert got == {("x", "Spill Events 2020", 0.5): 2.0}


def test_approximate_variant_is_close(spark):
    df = rows(spark)
    got = found(approximate_quantiles(df, ["c"], [0.5]))
    assert got[("c", 0.5)] == pytest.approx(np.nanmedian(df.toPandas().c), abs=5e6)
