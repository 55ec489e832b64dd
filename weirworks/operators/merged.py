"""Trees of any kind grown side by side in tasks, from rows that are merged first.

Equal rows of features, target and fold become one row with a count; where few enough are left, they are sent to all tasks once, and
every tree, boosting run or block of trees is a task of its own. Scores need sums of errors only, importances one row for each tree;
a fitted model is written as Spark's own stored model and read back as such. Where too many different rows are left, nothing is
merged and the caller fits with Spark's distributed trees.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import JavaMLReadable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.operators.growth import Forest, Merged, Recipe, Tree, Values
from weirworks.session import drop_path, scratch_path, ship_code

#: Numbers (different rows times features, target, fold and count) that are merged at most; they pass through the driver once.
MERGED_NUMBERS = 8_000_000
#: Trees of a forest that a task grows, and rows whose predictions are added up in one task.
BLOCK_TREES, BLOCK_ROWS = 10, 50_000

#: The table of nodes as Spark stores it.
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def merge_rows(df: DataFrame, features: Column, target: Column, fold: Column | None = None, most: int | None = None) -> Merged | None:
    """The different rows of an array of features with a target, in an order of their own; None if there are too many.

    Missing, endless and undefined numbers are refused, as Spark's trees refuse them, and so is a table without rows.
    """
    rows = df.select(features.alias("x"), target.cast("double").alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    found = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("x", "y", "fold")).alias("d"), F.max(F.size("x")).alias("width")).first()
    if not found.n:
        raise ValueError("no rows to fit")
    limit = (MERGED_NUMBERS if most is None else most) // ((found.width or 0) + 3)
    if found.d * 0.9 > limit:
        return None
    table = rows.groupBy("x", "y", "fold").agg(F.count("*").alias("n")).toArrow().combine_chunks()  # at most about ``limit`` rows
    if table.num_rows > limit:
        return None
    y, counts = table["y"].to_numpy().astype(np.float64), table["n"].to_numpy().astype(np.float64)
    fold_ = table["fold"].to_numpy()
    x = table["x"].combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if x.null_count or len(flat) != len(y) * found.width or not (np.isfinite(flat).all() and np.isfinite(y).all()):
        raise ValueError("a feature or the target is missing or not finite")
    flat = flat.reshape(len(y), found.width) + 0.0
    order = np.lexsort((fold_, y, *flat.T[::-1]))
    return Merged(Values(flat[order]), y[order], counts[order], fold_[order])


@dataclass(frozen=True)
class Fit:
    """A recipe fitted on all rows but those of a fold; on all rows without one."""

    recipe: Recipe
    fold: int | None = None


def error_sums(spark: SparkSession, merged: Merged, fits: Sequence[Fit]) -> list[dict[tuple[int, bool], dict[str, float]]]:
    """For each fit, scores by (point, whether held out): r2, mse, rmse, mae and n. Without a fold all rows count as held out."""
    ship_code(spark)
    context = spark.sparkContext
    shared = context.broadcast((merged, list(fits)))
    tasks = []
    for i, fit in enumerate(fits):
        if isinstance(fit.recipe, Forest):
            # Blocks end where a point's trees end, so that sums of blocks give every point.
            ends = sorted({*range(BLOCK_TREES, fit.recipe.trees, BLOCK_TREES), *[c.trees for c in fit.recipe.points()]})
            tasks += [(i, a, b) for a, b in zip([0, *ends], ends)]
        else:
            tasks.insert(0, (i, 0, 1))  # the longest tasks go first

    def run(task: tuple[int, int, int]) -> Iterator[tuple[tuple[int, int], tuple[int, np.ndarray]]]:
        data, wanted = shared.value
        i, first, last = task
        sums = data.summed(wanted[i].recipe, wanted[i].fold, first, last)
        for start in range(0, sums.shape[1], BLOCK_ROWS):
            yield (i, start), (last, sums[:, start : start + BLOCK_ROWS])

    def add(group: tuple[tuple[int, int], Iterable[tuple[int, np.ndarray]]]) -> Iterator[tuple[int, int, bool, list[float]]]:
        (i, start), parts = group
        data, wanted = shared.value
        fit = wanted[i]
        y, counts, held = (v[start : start + BLOCK_ROWS] for v in (data.y, data.counts, np.full(len(data.y), True) if fit.fold is None else data.fold == fit.fold))
        parts = sorted(parts, key=lambda p: p[0])
        if isinstance(fit.recipe, Forest):
            points = fit.recipe.points()
            place = {p: k for k, p in enumerate(sorted({(c.depth, c.split) for c in points}))}
            rows = lambda c: sum(p[place[c.depth, c.split]] for last, p in parts if last <= c.trees) / c.trees
        else:
            points, rows = (None,), lambda _: parts[0][1][0]
        for k, point in enumerate(points):
            missed = rows(point) - y
            for side in (True, False):
                own = np.where(held == side, counts, 0.0)
                yield i, k, side, [float(own.sum()), float((own * missed**2).sum()), float((own * np.abs(missed)).sum())]

    groups = max(1, len(fits) * -(-len(merged.y) // BLOCK_ROWS))
    found = context.parallelize(tasks, max(1, len(tasks))).flatMap(run).groupByKey(min(groups, 200)).flatMap(add).collect()  # a few numbers for each point
    shared.destroy()
    sums: list[dict[tuple[int, bool], np.ndarray]] = [{} for _ in fits]
    for i, k, side, numbers in found:
        sums[i][k, side] = sums[i].get((k, side), 0) + np.array(numbers)
    results = []
    for fit, own in zip(fits, sums):
        scores = {}
        for (k, side), (n, squared, absolute) in own.items():
            if not n:
                continue
            weights = np.where((merged.fold == fit.fold) == side, merged.counts, 0.0) if fit.fold is not None else merged.counts
            mean = (weights * merged.y).sum() / n
            spread, mse = (weights * (merged.y - mean) ** 2).sum(), squared / n
            found_ = {"r2": 1 - squared / spread if spread > 0 else float("nan"), "mse": mse, "rmse": mse**0.5, "mae": absolute / n, "n": n}
            scores[k, side] = {m: float(v) for m, v in found_.items()}
        results.append(scores)
    return results


def importances(spark: SparkSession, merged: Merged, forest: Forest) -> np.ndarray:
    """Mean share of every feature in the gains of a tree."""
    ship_code(spark)
    shared = spark.sparkContext.broadcast((merged, merged.binned(None)))
    blocks = range(0, forest.trees, BLOCK_TREES)

    def run(first: int) -> list[np.ndarray]:
        data, rows = shared.value
        return [tree.importances(len(rows.codes)) for tree in forest.grown(rows, data.counts, data.y, first, min(first + BLOCK_TREES, forest.trees))]

    found = spark.sparkContext.parallelize(blocks, len(blocks)).flatMap(run).collect()  # one row for each tree
    shared.destroy()
    total = np.sum(found, axis=0)
    return total / total.sum() if total.sum() else total


def node_batch(number: int, tree: Tree, borders: Sequence[np.ndarray]) -> pa.RecordBatch:
    """The nodes of a tree as Spark stores them."""
    n, end = len(tree.left), tree.end
    variance = np.maximum(tree.squares / tree.weight - tree.prediction**2, 0.0)
    width = max(1, max((len(b) for b in borders), default=1))
    padded = np.zeros((len(borders), width))
    for j, b in enumerate(borders):
        padded[j, : len(b)] = b
    threshold = padded[tree.feature[~end], tree.bin[~end]]
    offsets = np.concatenate([[0], np.cumsum(~end)]).astype(np.int32)
    split = pa.StructArray.from_arrays(
        [
            pa.array(np.where(end, -1, tree.feature), pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(threshold)),
            pa.array(np.full(n, -1), pa.int32()),
        ],
        names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    stats = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3), pa.int32()), pa.array(np.column_stack([tree.weight, tree.sum, tree.squares]).ravel()))
    columns = {
        "id": pa.array(np.arange(n), pa.int32()), "prediction": pa.array(tree.prediction), "impurity": pa.array(variance), "impurityStats": stats,
        "rawCount": pa.array(np.rint(tree.weight).astype(np.int64)), "gain": pa.array(tree.gain), "leftChild": pa.array(np.where(end, -1, tree.left), pa.int32()),
        "rightChild": pa.array(np.where(end, -1, tree.right), pa.int32()), "split": split,
    }
    node = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int32()), node], names=["treeID", "nodeData"])


def _metadata(spark: SparkSession, template, kind: str, **more) -> str:
    settings = {p.name: v for p, v in template._paramMap.items()}
    defaults = {p.name: v for p, v in template._defaultParamMap.items()}
    return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": template.uid, "paramMap": settings, "defaultParamMap": defaults, **more})


def stored_trees(spark: SparkSession, nodes: DataFrame, template, reader: type[JavaMLReadable], trees: int, features: int, weights: Sequence[float] | None = None):
    """Spark's own model of an estimator's kind from a table (treeID, nodeData), through its stored form in the shared folder."""
    path = scratch_path(spark, "grown")
    text = _metadata(spark, template, reader.__name__, numFeatures=features, numTrees=trees)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    if reader.__name__.startswith("DecisionTree"):
        nodes.select("nodeData.*").write.parquet(f"{path}/data")
    else:
        single = DecisionTreeRegressor(**{p.name: template.getOrDefault(p) for p in template.params if p.name in ("labelCol", "featuresCol", "predictionCol", "maxDepth", "seed")})
        each = [(i, _metadata(spark, single, "DecisionTreeRegressionModel"), 1.0 if weights is None else float(weights[i])) for i in range(trees)]
        each = [(i, text.replace(single.uid, f"{single.uid}_{i}"), w) for i, text, w in each]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        nodes.write.parquet(f"{path}/data")
    model = reader.load(path)
    drop_path(spark, path)
    return model


def grown_nodes(spark: SparkSession, merged: Merged, tasks: Sequence, grown: Callable[[Merged, object], Iterator[tuple[int, Tree, Sequence[np.ndarray]]]]) -> DataFrame:
    """(treeID, nodeData) of the trees that ``grown`` gives for each of ``tasks``."""
    ship_code(spark)
    shared = spark.sparkContext.broadcast((merged, list(tasks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, wanted = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for number, tree, borders in grown(data, wanted[i]):
                    yield node_batch(number, tree, borders)

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, NODES)


def grown_here(merged: Merged, spark: SparkSession, grown: Callable[[Merged], list]) -> list:
    """What ``grown`` gives, computed in one task: for trees that build on each other."""
    ship_code(spark)
    shared = spark.sparkContext.broadcast(merged)
    found = spark.sparkContext.parallelize([0], 1).flatMap(lambda _: grown(shared.value)).collect()  # one entry for each tree
    shared.destroy()
    return found


def local_nodes(spark: SparkSession, trees: Sequence[tuple[Tree, Sequence[np.ndarray]]]) -> DataFrame:
    """(treeID, nodeData) of trees that the driver has."""
    return spark.createDataFrame(pa.Table.from_batches([node_batch(i, tree, borders) for i, (tree, borders) in enumerate(trees)]), NODES)
