"""Exact quantiles without a per-group value map and without one task per group.

The built-in ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here
rows are counted per bucket of values (map-side combined, so only bucket totals are shuffled), the
buckets that hold the wanted ranks are picked from the totals, and only values of those buckets are
ordered. A picked bucket that is still crowded is split at borders from a mergeable quantile sketch of its own
values, again and again, until it holds few rows or one value; a border value is a part of its own, so every
round separates values, however close they lie or however far a stray one is. The first borders are pure
functions of the values and the later ones are stored, so a recomputed task always agrees with the rest.

The picked buckets are broadcast when their number is below ``SMALL_TARGETS`` (checked on the
actual rows); with more groups than that they stay a distributed table and the join shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.columns import quoted
from weirworks.operators.small import broadcast_if_small
from weirworks.session import materialised

LOG_STEPS = 64  # buckets per doubling of the value
SPLIT_BORDERS = 63  # sketch borders of a bucket that is split again
SKETCH_ACCURACY = 2000  # a border is off by at most this part of the bucket's rows
LARGE_BUCKET = 2_000_000  # rows above which a picked bucket is split again
SMALL_TARGETS = 20_000  # picked rows that may be broadcast


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value) for the values present; rows with a missing key are left out."""
    key_columns = [quoted(k) for k in keys]
    measures = [quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    narrow = df.select(*key_columns, *measures)
    for key in keys:
        narrow = narrow.filter(quoted(key).isNotNull())
    if len(columns) == 1:
        long = narrow.select(*key_columns, F.lit(columns[0]).alias("column"), F.col("v0").alias("value"))
    else:
        pairs = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)]
        long = narrow.select(*key_columns, F.inline(F.array(*pairs)))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _log_bucket(value: Column) -> Column:
    scaled = F.signum(value) * F.log1p(F.abs(value)) * (LOG_STEPS / 0.6931471805599453)
    return F.floor(F.least(F.greatest(scaled, F.lit(-1e6)), F.lit(1e6))).cast("int")


def _running(group: Sequence[str], order: Sequence[str]) -> Column:
    window = Window.partitionBy(*map(quoted, group)).orderBy(*map(quoted, order))
    return F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _holds_rank() -> Column:
    return (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))


def _with_ranks(totals: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Every row once per wanted rank: the neighbours (lo, hi) of each probability and the part between them."""
    position = F.col("prob") * (F.col("total") - 1)
    rank = F.when(F.col("side") == "lo", F.floor(position)).otherwise(F.ceil(position))
    return (
        totals.select("*", F.explode(F.lit([float(p) for p in probs])).alias("prob"))
        .select("*", F.explode(F.lit(["lo", "hi"])).alias("side"))
        .select("*", rank.cast("bigint").alias("rank"), (position - F.floor(position)).alias("part"))
    )


def _local(df: DataFrame, rows: Sequence[Row], names: Sequence[str]) -> DataFrame:
    """The distinct ``names`` part of collected rows as a small frame to broadcast."""
    schema = T.StructType([df.schema[n] for n in names])
    distinct = list(dict.fromkeys(tuple(row[n] for n in names) for row in rows))
    return F.broadcast(df.sparkSession.createDataFrame(distinct, schema))


def _refined(
    inside: DataFrame, ranks: DataFrame, cell: Sequence[str], step: str, small_targets: int, large_bucket: int
) -> tuple[DataFrame, DataFrame, bool]:
    """Crowded cells in parts: the rows and ranks of the parts that hold a wanted rank, and whether one is crowded still.

    Rows of ``inside`` are values with their number ``n``; a cell is crowded by its rows, as those are what is ordered.
    """
    crowded = (F.col("size") > large_bucket) & (F.col("low") < F.col("high"))
    shares = [(i + 1) / (SPLIT_BORDERS + 1) for i in range(SPLIT_BORDERS)]
    sketched = inside.groupBy(*map(quoted, cell)).agg(
        F.count("*").alias("size"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.array_distinct(F.percentile_approx("value", shares, SKETCH_ACCURACY)).alias("borders"),
    )
    # Stored, because a sketch depends on the order in which its parts meet.
    borders = materialised(sketched.filter(crowded).select(*map(quoted, cell), "borders"), "borders")
    below = F.size(F.filter("borders", lambda border: border < F.col("value")))
    part = 2 * below + F.array_contains("borders", F.col("value")).cast("int")
    number = F.when(F.col("borders").isNull(), F.lit(0)).otherwise(part)
    stepped = inside.join(broadcast_if_small(borders, small_targets), cell, "left").select(
        *map(quoted, cell), number.alias(step), "value", "n", "before"
    )
    finer = [*cell, step]
    parts = stepped.groupBy(*map(quoted, finer)).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("size"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.first("before").alias("start"),
    )
    before = F.col("start") + _running(cell, [step]) - F.col("n")
    held = parts.select("*", before.alias("before")).join(ranks, cell).filter(_holds_rank())
    names = ["prob", "side", "rank", "part", "before", "size", "low", "high"]
    held = materialised(held.select(*map(quoted, finer), *names), "ranks")
    kept = broadcast_if_small(held.select(*map(quoted, finer), "before").distinct(), small_targets)
    rows = materialised(stepped.drop("before").join(kept, finer), "cells")
    ranks = held.select(*map(quoted, finer), "prob", "side", "rank", "part")
    return rows, ranks, bool(held.filter(crowded).take(1))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    small_targets: int = SMALL_TARGETS,
    large_bucket: int = LARGE_BUCKET,
) -> DataFrame:
    """(keys, column, prob, value) with linear interpolation between neighbouring ranks."""
    group = [*keys, "column"]
    values = long_values(df, columns, keys).withColumn("bucket", _log_bucket(F.col("value")))
    totals = values.groupBy(*map(quoted, group), "bucket").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    total = F.sum("n").over(Window.partitionBy(*map(quoted, group)))
    spans = totals.select("*", (_running(group, ["bucket"]) - F.col("n")).alias("before"), total.alias("total"))
    picked = _with_ranks(spans, probs).filter(_holds_rank())
    bucket_names = [*group, "bucket", "low", "high", "before"]
    rank_names = [*group, "bucket", "prob", "side", "rank", "part"]
    rows = picked.limit(small_targets + 1).collect()
    small = len(rows) <= small_targets
    if small:
        buckets, ranks = _local(picked, rows, bucket_names), _local(picked, rows, rank_names)
        split = any(row["n"] > large_bucket and row["low"] < row["high"] for row in rows)
        counted = values.withColumn("n", F.lit(1).cast("bigint"))
    else:
        picked = materialised(picked, "ranks")  # a few rows per group, read twice below
        buckets, ranks = picked.select(*map(quoted, bucket_names)).distinct(), picked.select(*map(quoted, rank_names))
        split = bool(picked.filter((F.col("n") > large_bucket) & (F.col("low") < F.col("high"))).take(1))
        # Equal values meet before the join shuffles them, so a hot value is one row per group.
        counted = values.groupBy(*map(quoted, group), "bucket", "value").agg(F.count("*").alias("n"))

    inside = counted.join(buckets, [*group, "bucket"])
    cell = [*group, "bucket"]
    turn = 0
    while split:
        inside, ranks, split = _refined(inside, ranks, cell, f"step{turn}", small_targets, large_bucket)
        cell, turn = [*cell, f"step{turn}"], turn + 1

    # Order only the distinct values that share a cell with a wanted rank.
    last = inside.groupBy(*map(quoted, cell), "value").agg(F.sum("n").alias("n"), F.first("before").alias("start"))
    before = F.col("start") + _running(cell, ["value"]) - F.col("n")
    ends = last.select("*", before.alias("before")).join(ranks, cell).filter(_holds_rank())
    low = F.max(F.when(F.col("side") == "lo", F.col("value")))
    high = F.max(F.when(F.col("side") == "hi", F.col("value")))
    value = F.when(low == high, low).otherwise(low + (high - low) * F.max("part"))
    return ends.groupBy(*map(quoted, group), "prob").agg(value.alias("value"))


def quantile_table(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, column, <one output column per named probability>)."""
    long = exact_quantiles(df, columns, sorted(set(probs.values())), keys)
    picks = [
        F.max(F.when(F.col("prob") == F.lit(float(prob)), F.col("value"))).alias(name) for name, prob in probs.items()
    ]
    return long.groupBy(*map(quoted, [*keys, "column"])).agg(*picks)


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """The numbers per column in the order of ``probs``, for use as literals in a following pass."""
    found: dict[str, dict[float, float]] = {}
    for row in exact_quantiles(df, columns, probs).collect():
        found.setdefault(row["column"], {})[row["prob"]] = row["value"]
    return {column: [by_prob[float(p)] for p in probs] for column, by_prob in found.items()}


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Bounded-memory variant in a single pass; the rank error is at most rows / accuracy."""
    single = df.agg(
        *[
            F.percentile_approx(quoted(c).cast("double"), [float(p) for p in probs], accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(float(p)).alias("prob"),
            F.get(F.col(f"q{i}"), F.lit(j)).alias("value"),
        )
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    return single.select(F.inline(F.array(*rows)))
