"""Exact top-k inner-product search with a dual tree.

Data rows are dealt into blocks of bounded size. Each block gets a cover tree: nodes with a centre, a covering radius and
children, cut at leaves of a few points. The queries, in blocks of a fixed size, get a tree of the same kind. Query and data trees are descended
together: for a query node with centre q, radius r and a data node with centre p, radius s no score between them exceeds
q.p + |q| s + |p| r + r s, nor the product of the largest norms with the cosine of the angle left between the nodes' cones, so a data node goes once this bound is below the worst k-th score of the query node's queries.
Each task returns the best k of its blocks for each query, and a window over those picks the best of all.

Vectors become the integers floor(scale * x), with x as a double; scores are exact 64-bit integers.

Definitions: vectors that are null, empty, or hold a null or non-finite component take no part; nor do rows with a null id. Ties
go to the smaller id. A query never meets rows with its own id. Rows that repeat an id and a vector are one row. Vectors
of different lengths are compared within their length only. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.session import materialised

#: Rows of a data block, rows of a query block, points of a leaf.
BLOCK_ROWS = 4_096
QUERY_ROWS = 4_096
LEAF = 24
#: Queries of a leaf: few, because the worst k-th score of all of them decides what goes.
QUERY_LEAF = 4
#: A child covers this part less than its parent. Close to 1, so that spread points still come in several levels.
STEP = 1.3
SCALE = 256
#: Room for rounding in bounds, which are doubles; scores are integers.
SLACK = 1e-6
#: Below every score; an id above every id goes with it.
NONE = -(1 << 62)


class CoverTree:
    """Nodes in arrays: centre, covering radius, children (ranges of nodes) and points (ranges of ``order``).

    A node of covering radius R has children of at most R / ``step``, around points more than R / ``step`` apart; its own
    centre is the first of them. Nodes are opened down to ``leaf`` points or equal points, however far apart the points are.
    The points of a node are contiguous in ``order``, its centre first. For bounds, a node also has the smallest and
    largest norm of its points and their widest angle to the centre.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, step: float = 2.0):
        self.points, self.step = points.astype(np.float64), step
        self.norms = np.sqrt((self.points**2).sum(1))
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        self.reach: list[tuple[float, float, float, float]] = []
        if len(points):
            self._grow(leaf)
        self.span_of = np.array(self.span, dtype=np.int64).reshape(-1, 2)
        self.children_of = np.array(self.children, dtype=np.int64).reshape(-1, 2)
        self.radius_of, self.low_of, self.top_of, self.angle_of = np.array(self.reach).reshape(-1, 4).T
        first = np.array([start for start, _ in self.span], dtype=np.int64)
        self.centre_of, self.norm_of = self.points[self.order[first]], self.norms[self.order[first]]

    def _add(self, start: int, end: int) -> None:
        members = self.order[start:end]
        points, norms = self.points[members], self.norms[members]
        radius = float(np.sqrt(((points - points[0]) ** 2).sum(1).max()))
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = points @ points[0] / (norms * norms[0])
        angle = float(np.arccos(np.clip(np.nan_to_num(cosine, nan=-1.0), -1, 1)).max()) if end - start > 1 else 0.0
        self.span.append((start, end))
        self.children.append((0, 0))
        self.reach.append((radius, float(norms.min()), float(norms.max()), angle))

    def _grow(self, leaf: int) -> None:
        self._add(0, len(self.points))
        node = 0
        while node < len(self.span):
            (start, end), radius = self.span[node], self.reach[node][0]
            if end - start > leaf and radius > 0:
                first = len(self.span)
                for members in self._cover(start, end, radius / self.step):
                    self.order[start : start + len(members)] = members
                    self._add(start, start + len(members))
                    start += len(members)
                self.children[node] = (first, len(self.span))
            node += 1

    def _cover(self, start: int, end: int, within: float) -> list[np.ndarray]:
        """Balls around points more than ``within`` apart, the node's centre first; each point joins the first that holds it."""
        members, groups = self.order[start:end].copy(), []
        # Seen from the centre, so that rounding is small against the radius.
        points = self.points[members] - self.points[members[0]]
        squares, left = (points**2).sum(1), np.ones(len(members), dtype=bool)
        for at in range(len(members)):
            if left[at]:
                near = left & (squares + squares[at] - 2 * (points @ points[at]) <= within * within)
                near[at] = True
                groups.append(members[near])
                left &= ~near
        return groups


@dataclass
class Tally:
    """What a search did: node pairs that were bounded, node pairs that went, those of them with several points, scores computed.

    The bound of a node with one point costs as much as its score, so only ``pruned_groups`` saves work.
    """

    pairs: int = 0
    pruned: int = 0
    pruned_groups: int = 0
    scores: int = 0


class Best:
    """The best k (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.k, self.own = k, ids
        self.score = np.full((len(ids), k), NONE)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, queries: np.ndarray) -> int:
        return int(self.score[queries, -1].min())

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: queries x ids. The few that can enter are merged; a row met twice counts once."""
        scores = np.where(self.own[queries][:, None] == ids[None, :], NONE, scores)
        able = scores >= np.maximum(self.score[queries, -1:], NONE + 1)
        for row in np.flatnonzero(able.any(1)):
            q, new = queries[row], able[row]
            score = np.concatenate([self.score[q], scores[row, new]])
            ident = np.concatenate([self.id[q], ids[new]])
            ranked = np.lexsort((ident, -score))
            score, ident = score[ranked], ident[ranked]
            fresh = np.ones(len(score), dtype=bool)
            fresh[1:] = (score[1:] != score[:-1]) | (ident[1:] != ident[:-1]) | (score[1:] == NONE)
            self.score[q], self.id[q] = score[fresh][: self.k], ident[fresh][: self.k]


def search(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, best: Best, query_tree: CoverTree) -> Tally:
    """Descend both trees together and leave each query's best k in ``best``."""
    tree, tally = CoverTree(points, step=STEP), Tally()
    rows, wanted = points.astype(np.int64), queries.astype(np.int64)
    # Exact in doubles: integer products whose sums stay below 2^53; else in 64-bit integers.
    exact = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1] < 2**53
    fast_rows, fast_wanted = points.astype(np.float64), queries.astype(np.float64)

    def score(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        tally.scores += len(q) * len(p)
        return (fast_wanted[q] @ fast_rows[p].T).astype(np.int64) if exact else wanted[q] @ rows[p].T

    def bounds(node: int, nodes: np.ndarray) -> np.ndarray:
        """The smaller of two limits: centres and radii, and norms with the angle that is left between the two cones."""
        tally.pairs += len(nodes)
        reach, size, low, top = (float(of[node]) for of in (query_tree.radius_of, query_tree.norm_of, query_tree.low_of, query_tree.top_of))
        radius, norm = tree.radius_of[nodes], tree.norm_of[nodes]
        product = tree.centre_of[nodes] @ query_tree.centre_of[node]
        ball = product + size * radius + norm * reach + reach * radius
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.nan_to_num(product / (size * norm), nan=1.0, posinf=1.0, neginf=1.0)
        gap = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - query_tree.angle_of[node] - tree.angle_of[nodes], 0)
        along = np.cos(gap)
        cone = along * np.where(along > 0, top * tree.top_of[nodes], low * tree.low_of[nodes])
        return np.minimum(ball, cone) + SLACK * (1 + (size + reach) * (norm + radius))

    def gone(nodes: np.ndarray) -> None:
        tally.pruned += len(nodes)
        tally.pruned_groups += int((tree.span_of[nodes, 1] - tree.span_of[nodes, 0] > 1).sum())

    def members(of: CoverTree, node: int) -> np.ndarray:
        start, end = of.span_of[node]
        return of.order[start:end]

    def leaves(node: int, nodes: np.ndarray) -> None:
        """Every data node left for a leaf of queries, the most promising first."""
        asked = members(query_tree, node)
        while len(nodes):
            reach = bounds(node, nodes)
            able = reach >= best.worst(asked)
            gone(nodes[~able])
            nodes, reach = nodes[able], reach[able]
            final = tree.children_of[nodes, 1] == 0
            order = np.argsort(-reach[final], kind="stable")
            ready, high = nodes[final][order], reach[final][order]
            at, some = 0, 16
            while at < len(ready):
                part = ready[at : at + some]
                part = part[high[at : at + some] >= best.worst(asked)]
                if not len(part):  # those after it have lower bounds still
                    break
                p = np.concatenate([members(tree, x) for x in part])
                best.offer(asked, ids[p], score(asked, p))
                gone(ready[at + len(part) : at + some])
                at, some = at + some, 2 * some
            gone(ready[at:])
            nodes = opened(nodes[~final])

    def opened(nodes: np.ndarray) -> np.ndarray:
        spans = tree.children_of[nodes]
        return np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else nodes[:0]

    stack = [(0, np.zeros(1, dtype=np.int64))] if len(queries) and len(points) else []
    while stack:
        node, nodes = stack.pop()
        first, last = query_tree.children_of[node]
        if last == 0:
            leaves(node, nodes)
            continue
        able = bounds(node, nodes) >= best.worst(members(query_tree, node))
        gone(nodes[~able])
        nodes = nodes[able]
        # The side with the larger balls is opened: data nodes wider than the query node give way to their children.
        wide = (tree.radius_of[nodes] > query_tree.radius_of[node]) & (tree.children_of[nodes, 1] > 0)
        nodes = np.concatenate([nodes[~wide], opened(nodes[wide])])
        stack += [(child, nodes) for child in range(first, last)]
    return tally


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, vector of 64-bit integers) of the rows that take part; repeated rows once."""
    rows = pick(df, vec_id=id_col, vector=vector_col).where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.where(finite).select("vec_id", whole.alias("vector"))


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``data`` for every row of ``queries``.

    Queries go to the tasks one block of ``query_rows`` at a time, so a broadcast has a fixed size; data blocks never move.
    """
    spark = data.sparkSession
    ship(spark)
    points = whole_vectors(data, id_col, vector_col, scale)
    asked = materialised(whole_vectors(queries, id_col, vector_col, scale).distinct(), "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("vec_id", "vector").toPandas()
        part = _search_block(points, rows, k, block_rows) if len(rows) else None
        if part is not None:
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id", "score").agg(F.lit(1).alias("_one")).drop("_one")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(points: DataFrame, rows: pd.DataFrame, k: int, block_rows: int) -> DataFrame:
    by_length = {
        size: (group["vec_id"].to_numpy(np.int64), np.stack(group["vector"].to_numpy()).astype(np.int64))
        for size, group in rows.groupby(rows["vector"].map(len))
    }
    shared = points.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        best = {size: Best(ids, k) for size, (ids, _) in shared.value.items()}
        trees = {size: CoverTree(vectors, QUERY_LEAF, STEP) for size, (_, vectors) in shared.value.items()}

        def flush(parts: list[pd.DataFrame]) -> None:
            block = pd.concat(parts)
            for size, group in block.groupby(block["vector"].map(len)):
                if size in best:
                    points = np.stack(group["vector"].to_numpy()).astype(np.int64)
                    search(shared.value[size][1], group["vec_id"].to_numpy(np.int64), points, best[size], trees[size])

        held, count = [], 0
        for batch in batches:
            for start in range(0, len(batch), block_rows):
                held.append(batch.iloc[start : start + block_rows])
                count += len(held[-1])
                if count >= block_rows:
                    flush(held)
                    held, count = [], 0
        if count:
            flush(held)
        for size, kept in best.items():
            real = kept.id != np.iinfo(np.int64).max
            yield pd.DataFrame({
                "query_id": np.repeat(kept.own, kept.k)[real.ravel()], "vec_id": kept.id.ravel()[real.ravel()], "score": kept.score.ravel()[real.ravel()],
            })

    return points.mapInPandas(run, "query_id long, vec_id long, score long")


SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
