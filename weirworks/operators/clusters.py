"""Clustering: features, number of clusters, assignment, quality measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions.columns import quoted
from weirworks.operators.features import assembled
from weirworks.operators.lloyd import batched_kmeans
from weirworks.operators.regression import PopulationScaler, standard_scale
from weirworks.operators.rules import fill_median, flags_to_int
from weirworks.operators.small import broadcast_if_small
from weirworks.session import reused

MAX_CLUSTERS = 1000  # a clustering has a handful; this bounds the centroid table


def cluster_features(
    df: DataFrame, key: str, base: Sequence[str], optional: Sequence[str] = (), marker: str = "Flag"
) -> DataFrame:
    """Key, required and available optional features; flags as integers, gaps filled with the median."""
    absent = [c for c in base if c not in df.columns]
    if absent:
        raise ValueError(f"missing base features: {absent}")
    chosen = [*base, *[c for c in optional if c in df.columns]]
    flagged = flags_to_int(df.select(quoted(key), *map(quoted, chosen)), marker)
    return fill_median(flagged, chosen)


def find_k(
    df: DataFrame,
    features: Sequence[str],
    k_min: int = 2,
    k_max: int = 8,
    starts: int = 10,
    max_iter: int = 300,
    seed: int = 42,
) -> tuple[int, list[tuple[int, float]]]:
    """(chosen k, [(k, inertia)]): the best of ``starts`` runs per k, then the knee of the curve; all runs share their passes."""
    wanted = [(k, seed + start) for k in range(k_min, k_max + 1) for start in range(starts)]
    runs = batched_kmeans(standard_scale(df, features), features, wanted, max_iter)
    curve = [(k, min(run.cost for run in runs if run.k == k)) for k in range(k_min, k_max + 1)]
    chosen = knee(curve)
    return (chosen if chosen is not None else (k_min + k_max) // 2), curve


def elbow_curve(df: DataFrame, curve: Sequence[tuple[int, float]], chosen: int) -> DataFrame:
    rows = [(k, inertia, k == chosen) for k, inertia in curve]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, chosen boolean")


def knee(curve: Sequence[tuple[int, float]], sensitivity: float = 1.0) -> int | None:
    """Knee of a convex falling curve (Satopaa et al. 2011) over the few points of an elbow curve.

    Both axes are scaled to 0..1 and the curve is turned upside down; a knee is a local peak of its distance to the
    diagonal after which that distance falls below a threshold before the next peak.
    """
    (x0, y0), (x1, y1) = curve[0], curve[-1]
    top, bottom = max(y for _, y in curve), min(y for _, y in curve)
    if len(curve) < 3 or x1 == x0 or top == bottom or y0 < y1:
        return None
    distance = [(top - y) / (top - bottom) - (x - x0) / (x1 - x0) for x, y in curve]
    drop = sensitivity / (len(curve) - 1)
    peak = None
    for i in range(1, len(distance)):
        is_peak = i + 1 < len(distance) and distance[i] >= distance[i - 1] and distance[i] > distance[i + 1]
        if is_peak:
            peak = i
        elif peak is not None and distance[i] < distance[peak] - drop:
            return curve[peak][0]
        elif i + 1 < len(distance) and distance[i] <= min(distance[i - 1], distance[i + 1]):
            peak = None
    return None


def cluster_pipeline(features: Sequence[str], k: int, max_iter: int = 300, seed: int = 42) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw_features"),
            PopulationScaler("raw_features", "features"),
            KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster"),
        ]
    )


def assign_clusters(
    df: DataFrame, key: str, features: Sequence[str], k: int, max_iter: int = 300, seed: int = 42
) -> DataFrame:
    """Key, features and the cluster of every row."""
    rows = df.select(quoted(key), *map(quoted, features))
    with reused(rows) as data:
        model = cluster_pipeline(features, k, max_iter, seed).fit(data)
    return model.transform(rows).select(quoted(key), *map(quoted, features), "cluster")


def cluster_profile(assigned: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, size, mean of every feature)."""
    return assigned.groupBy(quoted(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), *[F.avg(quoted(c)).alias(f"mean_{c}") for c in features]
    )


def _distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return F.sqrt(reduce(add, ((a - b) * (a - b) for a, b in zip(left, right))))


def separation(df: DataFrame, features: Sequence[str], cluster: str, max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """(clusters, davies_bouldin, calinski_harabasz) from centroids; zeros for fewer than two clusters.

    Row-level work is one grouping for the centroids and one for the distances to them. Everything after that works on
    one row per cluster and meets in one task; more than ``max_clusters`` of them are refused, so raise it knowingly.
    """
    rows = df.select(quoted(cluster).alias("cluster"), *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    axes = range(len(features))
    centres = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"c{i}") for i in axes])
    centres = broadcast_if_small(centres, max_clusters)
    if centres.limit(max_clusters + 1).count() > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters in {cluster}; see max_clusters")
    spread = _distance([F.col(f"x{i}") for i in axes], [F.col(f"c{i}") for i in axes])
    within = (
        rows.join(centres, "cluster")
        .select("cluster", spread.alias("d"))
        .groupBy("cluster")
        .agg(F.avg("d").alias("scatter"), F.sum(F.col("d") * F.col("d")).alias("inside"))
    )
    per_cluster = centres.join(within, "cluster").select(
        "cluster", "n", "scatter", "inside", F.array(*[F.col(f"c{i}") for i in axes]).alias("centre")
    )
    collected = per_cluster.agg(F.collect_list(F.struct("cluster", "n", "scatter", "inside", "centre")).alias("g"))

    def apart(a: Column, b: Column) -> Column:
        gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)

    def worst(a: Column) -> Column:
        ratios = F.transform(
            F.filter("g", lambda b: b.getField("cluster") != a.getField("cluster")),
            lambda b: (a.getField("scatter") + b.getField("scatter"))
            / F.sqrt(apart(a.getField("centre"), b.getField("centre"))),
        )
        return F.array_max(ratios)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    k = F.size("g")
    n = total(F.transform("g", lambda c: c.getField("n").cast("double")))
    overall = F.transform(
        F.sequence(F.lit(0), F.lit(len(features) - 1)),
        lambda i: total(F.transform("g", lambda c: F.get(c.getField("centre"), i) * c.getField("n"))) / F.col("total"),
    )
    between = total(F.transform("g", lambda c: apart(c.getField("centre"), F.col("overall")) * c.getField("n")))
    inside = total(F.transform("g", lambda c: c.getField("inside")))
    named = collected.withColumn("total", n).withColumn("overall", overall)
    return named.select(
        k.cast("bigint").alias("clusters"),
        F.when(k >= 2, total(F.transform("g", worst)) / k).otherwise(0.0).alias("davies_bouldin"),
        F.when(k >= 2, between / (k - 1) / (inside / (F.col("total") - k))).otherwise(0.0).alias("calinski_harabasz"),
    )


def silhouette(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> float:
    """Silhouette with squared Euclidean distance (linear in the rows, unlike the Euclidean one)."""
    if len(df.select(quoted(cluster)).distinct().take(2)) < 2:
        return 0.0
    data = assembled(df, features).select("features", quoted(cluster).cast("int").alias("cluster"))
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(data)


def quality_label(score: Column) -> Column:
    return F.when(score > 0.7, "Excellent").when(score > 0.5, "Good").when(score > 0.3, "Fair").otherwise("Poor")
