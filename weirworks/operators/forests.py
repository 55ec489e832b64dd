"""Forests, single trees and boosted trees: grown from merged rows where these fit (see ``merged``), else by Spark's distributed trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.functions.columns import quoted
from weirworks.operators.growth import Boosted, Forest, Merged, Recipe, Single, Tree
from weirworks.operators.merged import BLOCK_TREES, grown_here, grown_nodes, importances, local_nodes, merge_rows, stored_trees
from weirworks.session import drop_path, scratch_path, ship_code

#: The deepest trees that Spark grows; "no depth limit" means this.
MAX_DEPTH = 30


class MergedEstimator(Estimator):
    """An estimator of trees; ``recipe`` says how they grow on merged rows, ``_distributed`` is Spark's estimator of the same model."""

    label_col: str
    features_col: str

    def recipe(self) -> Recipe:
        raise NotImplementedError

    def _distributed(self) -> Estimator:
        raise NotImplementedError

    def _grown(self, merged: Merged, dataset: DataFrame) -> Model:
        raise NotImplementedError

    def merged(self, dataset: DataFrame) -> Merged | None:
        return merge_rows(dataset, vector_to_array(quoted(self.features_col)), quoted(self.label_col))

    def _fit(self, dataset: DataFrame) -> Model:
        merged = self.merged(dataset)
        return self._distributed().fit(dataset) if merged is None else self._grown(merged, dataset)


class NodeArrays:
    """The nodes of all trees, tree by tree: an end is its own left child, a right child follows the left one."""

    def __init__(self, spark: SparkSession, path: str):
        ends = F.col("nodeData.leftChild") < 0
        flat = spark.read.parquet(path).select(
            F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.prediction").alias("prediction"),
            F.when(ends, 0).otherwise(F.col("nodeData.split.featureIndex")).cast("short").alias("feature"),
            F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("border"),
        ).toArrow()
        tree, node = flat["tree"].to_numpy(), flat["node"].to_numpy()
        order = np.lexsort((node, tree))
        left = flat["left"].to_numpy()[order]
        self.starts = np.flatnonzero(node[order] == 0)
        self.border, self.prediction, self.feature = (flat[c].to_numpy()[order] for c in ("border", "prediction", "feature"))
        self.left = np.where(left < 0, node[order], left).astype(np.int32)

    def tree(self, number: int) -> tuple[np.ndarray, ...]:
        part = slice(self.starts[number], self.starts[number + 1] if number + 1 < len(self.starts) else None)
        return self.left[part], self.feature[part], self.border[part], self.prediction[part]

    def votes(self, number: int, values: np.ndarray) -> np.ndarray:
        """Predictions of one tree."""
        left, feature, border, prediction = self.tree(number)
        node, open_ = np.zeros(len(values), dtype=np.int32), np.arange(len(values))
        while len(open_):
            at = node[open_]
            inner = left[at] != at
            open_, at = open_[inner], at[inner]
            node[open_] = left[at] + ~(values[open_, feature[at]] <= border[at])
        return prediction[node]

    def predict(self, values: np.ndarray, join: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Means of all trees' predictions, or what ``join`` makes of them (trees by rows)."""
        if join is not None:
            return join(np.stack([self.votes(i, values) for i in range(len(self.starts))]))
        return sum(self.votes(i, values) for i in range(len(self.starts))) / len(self.starts)


class ForestTree:
    """One tree of a forest."""

    def __init__(self, nodes: NodeArrays, number: int):
        self.nodes, self.number = nodes, number

    @property
    def numNodes(self) -> int:
        return len(self.nodes.tree(self.number)[0])

    def predict(self, value: DenseVector) -> float:
        return float(self.nodes.votes(self.number, value.toArray()[None])[0])


class ForestModel(Model, MLWritable, MLReadable):
    """A fitted forest, whose nodes lie in a table (treeID, nodeData) in the shared folder, as Spark stores those of its own forests.

    Full-depth forests have millions of nodes, as objects of the JVM too many for a small driver. Here they are read as flat arrays
    when rows are first to be predicted, and sent to the tasks once.
    """

    def __init__(self, path: str, features: int, features_col: str = "features"):
        super().__init__()
        self.path, self.numFeatures, self.features_col = path, features, features_col
        self._arrays: NodeArrays | None = None
        self._shared: Broadcast | None = None

    @property
    def nodes(self) -> NodeArrays:
        if self._arrays is None:
            self._arrays = NodeArrays(SparkSession.active(), self.path)
        return self._arrays

    @property
    def trees(self) -> list[ForestTree]:
        return [ForestTree(self.nodes, i) for i in range(len(self.nodes.starts))]

    @property
    def totalNumNodes(self) -> int:
        return SparkSession.active().read.parquet(self.path).count()

    @property
    def featureImportances(self) -> DenseVector:
        splits = SparkSession.active().read.parquet(self.path).where("nodeData.leftChild >= 0").select("treeID", F.col("nodeData.split.featureIndex").alias("feature"), (F.col("nodeData.gain") * F.col("nodeData.rawCount")).alias("gain"))
        gains = splits.groupBy("treeID", "feature").agg(F.sum("gain").alias("gain"))
        whole = gains.groupBy("treeID").agg(F.sum("gain").alias("whole"))
        shares = gains.join(whole, "treeID").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share")).collect()  # one row for each feature
        total = np.zeros(self.numFeatures)
        for row in shares:
            total[row.feature] = row.share
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def copy(self, extra=None) -> ForestModel:
        copied = ForestModel(self.path, self.numFeatures, self.features_col)
        copied._resetUid(self.uid)
        return copied

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.predicted(dataset)

    def predicted(self, dataset: DataFrame, join: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """With the column ``prediction``: the mean of the trees, or what ``join`` makes of their predictions (trees by rows)."""
        ship_code(dataset.sparkSession)
        if self._shared is None:
            self._shared = dataset.sparkSession.sparkContext.broadcast(self.nodes)
            self._arrays = None
        shared = self._shared

        def predict(rows: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict(np.stack(rows.to_numpy()), join) if len(rows) else [], dtype="float64")

        return dataset.withColumn("prediction", F.pandas_udf(predict, "double")(vector_to_array(quoted(self.features_col))))

    def release(self) -> None:
        """Delete the nodes of a model that is not used any more."""
        if self._shared is not None:
            self._shared.destroy()
        drop_path(SparkSession.active(), self.path)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        facts = {"features": self.model.numFeatures, "features_col": self.model.features_col}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"facts": facts})
        stored_nodes(self.sparkSession.read.parquet(self.model.path), f"{path}/data")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        # A copy, so that the model outlives the place it is read from.
        nodes = stored_nodes(self.sparkSession.read.parquet(f"{path}/data"), scratch_path(self.sparkSession, "forest"))
        model = ForestModel(nodes, metadata["facts"]["features"], metadata["facts"]["features_col"])
        model._resetUid(metadata["uid"])
        return model


def stored_nodes(nodes: DataFrame, path: str) -> str:
    nodes.write.option("compression", "zstd").parquet(path)
    return path


class GrownForest(MergedEstimator):
    """A random forest whose nodes may split by every feature.

    A bag holds each row a Poisson number of times. Merged rows are drawn in an order of their own, so a model depends on the
    rows and the seed, not on partitions, and a smaller forest is the first trees of a larger one.
    """

    def __init__(self, label_col: str, features_col: str = "features", trees: int = 100, depth: int = MAX_DEPTH, seed: int = 42, min_leaf: int = 1):
        super().__init__()
        self.label_col, self.features_col = label_col, features_col
        self.trees, self.depth, self.seed, self.min_leaf = trees, depth, seed, min_leaf

    def recipe(self) -> Forest:
        return Forest(self.trees, self.depth, self.min_leaf, self.seed)

    def _distributed(self) -> RandomForestRegressor:
        # Rows keep the number of their node between levels, so deep trees do not travel with the tasks.
        return RandomForestRegressor(
            labelCol=self.label_col, featuresCol=self.features_col, numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.min_leaf,
            seed=self.seed, featureSubsetStrategy="all", cacheNodeIds=True,
        )

    def _grown(self, merged: Merged, dataset: DataFrame) -> ForestModel:
        recipe, spark = self.recipe(), dataset.sparkSession

        def block(data: Merged, first: int) -> Iterator[tuple[int, Tree, Sequence[np.ndarray]]]:
            rows, last = data.binned(None), min(first + BLOCK_TREES, recipe.trees)
            for number, tree in zip(range(first, last), recipe.grown(rows, data.counts, data.y, first, last)):
                yield number, tree, rows.borders

        nodes = grown_nodes(spark, merged, range(0, self.trees, BLOCK_TREES), block)
        return ForestModel(stored_nodes(nodes, scratch_path(spark, "forest")), len(merged.values.values), self.features_col)

    def importances(self, dataset: DataFrame) -> list[float]:
        """The importances of the fitted model's features; no model is made for merged rows."""
        merged = self.merged(dataset)
        if merged is None:
            return self._distributed().fit(dataset).featureImportances.toArray().tolist()
        return importances(dataset.sparkSession, merged, self.recipe()).tolist()


class GrownTree(MergedEstimator):
    """One tree on all rows."""

    def __init__(self, label_col: str, features_col: str = "features", depth: int = MAX_DEPTH, seed: int = 42):
        super().__init__()
        self.label_col, self.features_col, self.depth, self.seed = label_col, features_col, depth, seed

    def recipe(self) -> Single:
        return Single(self.depth)

    def _distributed(self) -> DecisionTreeRegressor:
        return DecisionTreeRegressor(labelCol=self.label_col, featuresCol=self.features_col, maxDepth=self.depth, seed=self.seed)

    def _grown(self, merged: Merged, dataset: DataFrame) -> DecisionTreeRegressionModel:
        recipe = self.recipe()

        def whole(data: Merged, _: int) -> Iterator[tuple[int, Tree, Sequence[np.ndarray]]]:
            rows = data.binned(None)
            yield 0, recipe.grown(rows, data.counts, data.y), rows.borders

        nodes = grown_nodes(dataset.sparkSession, merged, [0], whole)
        return stored_trees(dataset.sparkSession, nodes, self._distributed(), DecisionTreeRegressionModel, 1, len(merged.values.values))


class GrownBoost(MergedEstimator):
    """Gradient-boosted trees on the squared error."""

    def __init__(self, label_col: str, features_col: str = "features", rounds: int = 100, depth: int = 3, step: float = 0.1, seed: int = 42):
        super().__init__()
        self.label_col, self.features_col = label_col, features_col
        self.rounds, self.depth, self.step, self.seed = rounds, depth, step, seed

    def recipe(self) -> Boosted:
        return Boosted(self.rounds, self.depth, self.step)

    def _distributed(self) -> GBTRegressor:
        return GBTRegressor(labelCol=self.label_col, featuresCol=self.features_col, maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, seed=self.seed)

    def _grown(self, merged: Merged, dataset: DataFrame) -> GBTRegressionModel:
        recipe, spark = self.recipe(), dataset.sparkSession

        def boosted(data: Merged) -> list:
            rows = data.binned(None)
            return [(tree, weight, rows.borders) for tree, weight in recipe.grown(rows, data.counts, data.y)]

        found = grown_here(merged, spark, boosted)
        nodes = local_nodes(spark, [(tree, borders) for tree, _, borders in found])
        return stored_trees(spark, nodes, self._distributed(), GBTRegressionModel, len(found), len(merged.values.values), [w for _, w, _ in found])


def forest(
    target: str, trees: int = 100, depth: int | None = None, seed: int = 42, features: str = "features", min_leaf: int = 1
) -> GrownForest:
    """A random forest whose nodes may split by every feature; without a depth, trees grow as deep as Spark lets them."""
    if depth is not None and depth > MAX_DEPTH:
        raise ValueError(f"Spark grows trees to depth {MAX_DEPTH}, not {depth}")
    return GrownForest(target, features, trees, depth or MAX_DEPTH, seed, min_leaf)
