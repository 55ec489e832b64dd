"""Registered model and cluster jobs do the operators' whole work and return all tables."""

import inspect
import json

import pytest

from weirworks.catalog import load
from weirworks.catalog.model_queries import SITE_AXES, SITE_FEATURES, DIMS
from weirworks.operators import clusters, tuning
from weirworks.plans import modelling
from weirworks.session import fit_input

QUERIES = load()[0]


class Called(Exception):
    """Carries the arguments that a query gives to its operator."""


@pytest.mark.parametrize(
    ("name", "module", "operator", "features"),
    [
        ("grid_search", tuning, "grid_search", SITE_FEATURES),
        ("random_search", tuning, "random_search", SITE_FEATURES),
        ("adaptive_search", tuning, "adaptive_search", SITE_FEATURES),
        ("compare_models", tuning, "compare_models", SITE_FEATURES),
        ("find_k", clusters, "find_k", SITE_AXES),
        ("elbow_curve", clusters, "find_k", DIMS),
        ("model_workflow", modelling, "model_workflow", SITE_FEATURES),
        ("cluster_workflow", modelling, "cluster_workflow", None),
    ],
)
def test_registered_jobs_keep_the_defaults(spark, sf_dir, monkeypatch, name, module, operator, features):
    signature = inspect.signature(getattr(module, operator))

    def record(*args, **kwargs):
        raise Called(signature.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as caught:
        QUERIES[name](spark, sf_dir)
    given = caught.value.args[0]
    shrinkable = {p.name for p in signature.parameters.values() if p.default is not inspect.Parameter.empty} - {"optional"}
    assert not shrinkable & set(given)
    assert features is None or tuple(given["features"]) == tuple(features)


def test_long_form_has_every_row_of_every_table(spark):
    tables = {
        "first": spark.createDataFrame([(1, None), (2, 0.5)], "k int, v double"),
        "second": spark.createDataFrame([("a",)], "name string"),
    }
    found = sorted((r.result, json.loads(r.row)) for r in modelling.long_form(tables).collect() if r.result == "second")
    assert found == [("second", {"name": "a"})]
    rows = [json.loads(r.row) for r in modelling.long_form(tables).collect() if r.result == "first"]
    assert sorted(rows, key=lambda r: r["k"]) == [{"k": 1, "v": None}, {"k": 2, "v": 0.5}]


def test_fit_input_depends_on_the_rows_only(spark):
    rows = spark.range(0, 400).selectExpr("id % 2 AS k", "CAST(id AS DOUBLE) AS x", "IF(id % 3 = 0, NULL, id) AS y")
    layouts = []
    for df in (rows.coalesce(1), rows.repartition(7), rows.repartition(40)):
        with fit_input(df, "k", rows_per_task=20) as spread:
            layouts.append(spread.rdd.glom().collect())
    assert layouts[0] == layouts[1] == layouts[2]
    assert len(layouts[0]) == 20 and max(map(len, layouts[0])) < 60
