"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step points neighbours at the smallest node seen, so a component shrinks to a star in a few rounds. A step is a minimum
for each node (combined before the shuffle) and a join on the node, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.session import drop_path, scratch_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: of every node, the larger neighbours; small: the smaller ones and itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:  # a row for each edge at most: only what a small step leaves has its repeats taken out
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return joined.select(F.inline(moved)).where("u <> v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none of those has one itself."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counts = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node that has an edge; ``edges`` has columns a, b."""
    spark = edges.sparkSession
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = scratch_path(spark, "edges")
    tidy.write.parquet(path)
    kept = spark.read.schema(tidy.schema).parquet(path)
    while not _only_stars(kept):
        old = path
        path = scratch_path(spark, "edges")
        _star(_star(kept, True), False).write.parquet(path)
        kept = spark.read.schema(tidy.schema).parquet(path)
        drop_path(spark, old)
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
