"""Whole modelling and clustering workflows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import quoted
from weirworks.operators import charts
from weirworks.operators.clusters import (
    assign_clusters,
    cluster_features,
    cluster_profile,
    elbow_curve,
    find_k,
    quality_label,
    separation,
    silhouette,
)
from weirworks.operators.features import importance_table, interaction_features, select_importance
from weirworks.operators.groups import top_features
from weirworks.operators.regression import MODEL_NAMES, batch_predict, regression_metrics, standard_scale
from weirworks.operators.rules import require_input
from weirworks.operators.tuning import DEFAULT_GRID, compare_models, grid_search, refit_best, search_table
from weirworks.session import materialised
from weirworks.sources.sinks import load_model, save_model


def model_workflow(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    path: str,
    names: Sequence[str] = MODEL_NAMES,
    grid: Mapping[str, Sequence[int | None]] = DEFAULT_GRID,
    trees: int = 100,
    folds: int = 5,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Complete rows, interactions, selection by importance, comparison, search, stored model, predictions, charts."""
    complete = require_input(df, [*features, target], min_rows=10)
    wide = interaction_features(complete.select(quoted(key), *map(quoted, [*features, target])), features)
    wide = materialised(wide, "model-input")  # read by every fit below
    candidates = [c for c in wide.columns if c not in (key, target)]
    picked = select_importance(wide, candidates, target, trees=trees, seed=seed)
    chosen = [r["feature"] for r in picked.filter("selected").collect()]
    comparison = compare_models(wide, key, chosen, target, names, folds, trees, seed)
    results = grid_search(wide, key, chosen, target, grid, folds, seed=seed)
    save_model(refit_best(wide, chosen, target, results, seed), path)
    model = load_model(df.sparkSession, path)
    predictions = batch_predict(model, wide, key, chosen)
    paired = charts.residuals(wide.select(quoted(key), quoted(target)).join(predictions, key), key, target, "prediction")
    return {
        "importances": top_features(importance_table(wide, chosen, target, trees=trees, seed=seed)),
        "comparison": comparison,
        "comparison_chart": charts.comparison_table(comparison),
        "search": search_table(df, results),
        "predictions": predictions,
        "residuals": paired,
        "fit": charts.fit_line(paired),
        "metrics": regression_metrics(paired, "actual", "predicted"),
    }


def cluster_workflow(
    df: DataFrame,
    key: str,
    base: Sequence[str],
    optional: Sequence[str] = (),
    k_min: int = 2,
    k_max: int = 8,
    starts: int = 10,
    max_iter: int = 300,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Features, elbow curve, clusters of the chosen size, their profile and quality."""
    prepared = materialised(cluster_features(df, key, base, optional), "cluster-input")
    features = [c for c in prepared.columns if c != key]
    chosen, curve = find_k(prepared, features, k_min, k_max, starts, max_iter, seed)
    assigned = materialised(assign_clusters(prepared, key, features, chosen, max_iter, seed), "clusters")
    scaled = standard_scale(assigned, features)
    score = silhouette(scaled, features)
    quality = separation(scaled, features, "cluster").select(
        "*", F.lit(score).alias("silhouette_squared"), quality_label(F.lit(score)).alias("quality")
    )
    return {
        "elbow": elbow_curve(df, curve, chosen),
        "assigned": assigned,
        "profile": cluster_profile(assigned, features),
        "quality": quality,
    }


def long_form(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(result, row): every row of every table of a workflow, as JSON with its missing values."""
    parts = [
        df.select(F.lit(name).alias("result"), F.to_json(F.struct(*map(quoted, df.columns)), {"ignoreNullFields": "false"}).alias("row"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)
