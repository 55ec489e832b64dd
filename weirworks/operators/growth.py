"""Regression trees grown in memory from merged rows.

Rows are binned as Spark's trees bin them, and rows with the same bins meet in one cell: a tree needs the weight, the sum and the
sum of squares of each cell, nothing else. A level of a tree takes its open cells once for each feature: sums by (node, bin),
running sums within each node, and the best border of each. Gains that agree to nine digits count as equal, and the first feature
and border of them are taken, so no tree depends on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bins of a feature, as many as Spark's trees have unless told otherwise.
BINS = 32
#: Shares of a node's spread below which a spread or a gain is a rounding error, and within which two gains are equal.
NOISE, EQUAL = 1e-13, 1e-9


def borders(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Borders between bins of one feature: all midpoints of few values, else those next to even shares of the weight.

    ``values`` are different and ascending. The rule is that of Spark's trees.
    """
    kept = weights > 0
    values, weights = values[kept], weights[kept]
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle
    stride = weights.sum() / bins
    reached = np.cumsum(weights)
    half, found, target, at = (reached[:-1] + reached[1:]) / 2, [], stride, 0
    while at < len(half):
        at += int(np.searchsorted(half[at:], target, side="right"))
        if at < len(half):
            found.append(at)
            target, at = target + stride, at + 1
    return middle[found]


class Values:
    """Different rows of features as places among the ascending different values of each feature."""

    def __init__(self, rows: np.ndarray):
        found = [np.unique(rows[:, j], return_inverse=True) for j in range(rows.shape[1])]
        self.values = [f[0] for f in found]
        self.places = [f[1].astype(np.int32) for f in found]

    def binned(self, weights: np.ndarray, bins: int = BINS) -> Binned:
        """Bins by the rows with weight; the others fall into the bins of those."""
        cuts, codes = [], np.empty((len(self.values), len(weights)), dtype=np.uint8)
        for j, (values, places) in enumerate(zip(self.values, self.places)):
            cuts.append(borders(values, np.bincount(places, weights, len(values)), bins))
            codes[j] = np.searchsorted(cuts[j], values)[places]
        cell = np.zeros(len(weights), dtype=np.int64)
        for j in range(len(codes)):  # numbered again after each feature, so any number of features fits
            cell = np.unique(cell * bins + codes[j], return_inverse=True)[1].astype(np.int64)
        first = np.unique(cell, return_index=True)[1]
        return Binned(cuts, np.ascontiguousarray(codes[:, first]), cell, bins)


@dataclass
class Binned:
    """Borders of the features, bins of every cell (features by cells), and the cell of every row."""

    borders: list[np.ndarray]
    codes: np.ndarray
    cell: np.ndarray
    bins: int

    def sums(self, weights: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, sum and sum of squares of every cell."""
        n, weighted = self.codes.shape[1], weights * y
        return np.bincount(self.cell, weights, n), np.bincount(self.cell, weighted, n), np.bincount(self.cell, weighted * y, n)


@dataclass
class Tree:
    """Nodes in order of level; an end has itself as both children, and feature and bin 0."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    weight: np.ndarray
    sum: np.ndarray
    squares: np.ndarray
    gain: np.ndarray
    end: np.ndarray
    depth: np.ndarray

    @property
    def right(self) -> np.ndarray:
        return np.where(self.end, self.left, self.left + 1)

    @property
    def prediction(self) -> np.ndarray:
        return self.sum / self.weight

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The end in which every cell falls."""
        node = np.zeros(codes.shape[1], dtype=np.int32)
        if self.end[0]:
            return node
        flat, width = codes.ravel(), codes.shape[1]
        start = self.feature.astype(np.int64) * width
        open_ = np.arange(width)
        while len(open_):
            at = node[open_]
            at = self.left[at] + (flat[start[at] + open_] > self.bin[at])
            node[open_] = at
            open_ = open_[~self.end[at]]
        return node

    def importances(self, features: int) -> np.ndarray:
        """Shares of the weighted gains of all splits by feature, as Spark counts them."""
        inner = ~self.end
        total = np.bincount(self.feature[inner], self.gain[inner] * self.weight[inner], features)
        return total / total.sum() if total.sum() else total

    def stopped(self, depth: int, split: float) -> np.ndarray:
        """For every end, the prediction of the first node on its way that is at ``depth`` or has less weight than ``split``."""
        value, parent = self.prediction.copy(), self.parents()
        stop = (self.depth >= depth) | (self.weight < split) | self.end
        for level in range(1, int(self.depth[-1]) + 1):
            a, b = np.searchsorted(self.depth, [level, level + 1])
            above = parent[a:b]
            done = stop[above]
            value[a:b][done] = value[above][done]
            stop[a:b] |= done
        return value

    def parents(self) -> np.ndarray:
        parent = np.zeros(len(self.left), dtype=np.int64)
        inner = np.flatnonzero(~self.end)
        parent[self.left[inner]] = inner
        parent[self.left[inner] + 1] = inner
        return parent


def grow(binned: Binned, weight: np.ndarray, total: np.ndarray, squares: np.ndarray, depth: int, min_leaf: float = 1) -> Tree:
    """A tree on cells with weights: every node is split by the border of the largest gain that leaves ``min_leaf`` on both sides.

    Nodes end at ``depth``, without spread, or where no border gains.
    """
    widths = [len(b) + 1 for b in binned.borders]
    cells = np.flatnonzero(weight)
    codes, w, s, q = binned.codes[:, cells].astype(np.int64), weight[cells], total[cells], squares[cells]
    centre = s.sum() / w.sum()  # sums of squares lose fewest digits around the mean
    q, s = q - 2 * centre * s + centre**2 * w, s - centre * w
    node, start, level = np.zeros(len(cells), dtype=np.int64), 0, 0
    W, S, Q = np.array([w.sum()]), np.array([s.sum()]), np.array([q.sum()])
    noise = NOISE * max(Q[0], 0.0) / W[0]
    parts: list[list[np.ndarray]] = []
    # Nodes of the level: id start.., rows of ``node`` count from 0 among the open ones.
    here = np.arange(1)  # places of the open nodes in their level
    while True:
        m = len(W)
        feature, cut, left, gain, end = np.zeros(m, np.int32), np.zeros(m, np.int16), start + np.arange(m, dtype=np.int32), np.full(m, -1.0), np.ones(m, bool)
        parts.append([feature, cut, left, W, S, Q, gain, end, np.full(m, level, np.int16)])
        if not len(here) or level == depth:
            break
        k = len(here)
        mean = S[here] / W[here]
        missed = s - mean[node] * w
        spread = NOISE * np.maximum(Q[here] - S[here] * mean, 0.0)
        best, f, c = np.zeros(k), np.full(k, -1, np.int32), np.zeros(k, np.int16)
        for j, bins in enumerate(widths):
            key = node * bins + codes[j]
            hw = np.bincount(key, w, k * bins)
            at = np.flatnonzero(hw)
            own = at // bins
            first = np.flatnonzero(np.diff(own, prepend=-1))  # every open node has rows
            lw, ls = np.cumsum(hw[at]), np.cumsum(np.bincount(key, missed, k * bins)[at])
            lw -= np.concatenate([[0.0], lw[first[1:] - 1]])[own]
            ls -= np.concatenate([[0.0], ls[first[1:] - 1]])[own]
            whole = W[here][own]
            rw = whole - lw
            usable = (lw >= min_leaf) & (rw >= min_leaf) & (rw > whole * 1e-12)
            score = np.where(usable, ls * ls * whole / np.where(usable, lw * rw, 1.0), -1.0)
            top = np.maximum.reduceat(score, first)
            better = (top > best * (1 + EQUAL)) & (top > spread)
            picked = np.flatnonzero((score >= (top * (1 - EQUAL))[own]) & better[own])
            chosen = at[picked[::-1]]
            c[chosen // bins] = chosen % bins  # written last, the first of equals stays
            f[better], best = j, np.where(better, top, best)
        splits = f >= 0
        split = np.flatnonzero(splits)
        f, c = f[split], c[split]
        which = here[split]
        start += m
        feature[which], cut[which], gain[which], end[which] = f, c, best[split] / W[which], False
        left[which] = start + 2 * np.arange(len(split))
        if not len(split):
            break
        # Cells of split nodes move on to the children.
        rank = np.full(k, -1)
        rank[split] = np.arange(len(split))
        moves = rank[node]
        stay = moves >= 0
        codes, w, s, q, moves = codes[:, stay], w[stay], s[stay], q[stay], moves[stay]
        child = 2 * moves + (codes[f[moves], np.arange(len(w))] > c[moves])
        W, S, Q = (np.bincount(child, x, 2 * len(split)) for x in (w, s, q))
        number = np.bincount(child, minlength=2 * len(split))
        goes_on = (number > 1) & (W >= 2 * min_leaf) & (Q - S * S / W > noise * W)
        here = np.flatnonzero(goes_on)
        rank = np.full(len(W), -1)
        rank[here] = np.arange(len(here))
        node = rank[child]
        stay = node >= 0
        codes, w, s, q, node = codes[:, stay], w[stay], s[stay], q[stay], node[stay]
        level += 1
    feature, cut, left, W, S, Q, gain, end, levels = (np.concatenate(x) for x in zip(*parts))
    return Tree(feature, cut, left, W, S + centre * W, Q + 2 * centre * S + centre**2 * W, gain, end, levels)


def bag(seed: int, tree: int, counts: np.ndarray) -> np.ndarray:
    """How often a tree's bag holds each of the merged rows: the sum of as many Poisson draws as the row has copies."""
    return np.random.default_rng([seed & 0xFFFFFFFF, tree]).poisson(counts).astype(np.float64)


@dataclass(frozen=True)
class Cut:
    """A point that one deep forest answers: trees used, deepest level kept, rows that a node needs to be split."""

    trees: int
    depth: int
    split: int = 2


@dataclass(frozen=True)
class Forest:
    """Trees on bags of all rows; ``cuts`` are the predictions wanted, the whole forest unless given."""

    trees: int
    depth: int
    min_leaf: int
    seed: int
    cuts: tuple[Cut, ...] = ()

    def points(self) -> tuple[Cut, ...]:
        return self.cuts or (Cut(self.trees, self.depth),)

    def grown(self, rows: Binned, counts: np.ndarray, y: np.ndarray, first: int, last: int) -> Iterator[Tree]:
        for tree in range(first, last):
            weights = bag(self.seed, tree, counts)
            if not weights.any():  # a bag of one or two rows may be empty
                weights = counts
            yield grow(rows, *rows.sums(weights, y), self.depth, self.min_leaf)


@dataclass(frozen=True)
class Single:
    """One tree on all rows."""

    depth: int

    def grown(self, rows: Binned, counts: np.ndarray, y: np.ndarray) -> Tree:
        return grow(rows, *rows.sums(counts, y), self.depth)


@dataclass(frozen=True)
class Boosted:
    """Gradient boosting of squared errors, as Spark's: the first tree counts whole, the others by ``step`` and fit twice what is missed."""

    rounds: int
    depth: int
    step: float

    def grown(self, rows: Binned, counts: np.ndarray, y: np.ndarray) -> list[tuple[Tree, float]]:
        w, s, q = rows.sums(counts, y)
        trees, predicted = [], np.zeros(len(w))
        for turn in range(self.rounds):
            if turn:
                tree = grow(rows, w, 2 * (s - predicted * w), 4 * (q - 2 * predicted * s + predicted**2 * w), self.depth)
            else:
                tree = grow(rows, w, s, q, self.depth)
            trees.append((tree, self.step if turn else 1.0))
            predicted += trees[-1][1] * tree.prediction[tree.leaves(rows.codes)]
        return trees


@dataclass(frozen=True)
class Adaptive:
    """AdaBoost.R2 (Drucker 1997) with the linear loss over weighted trees, binned anew by the weights of each round."""

    rounds: int
    depth: int
    rate: float

    def grown(self, values: Values, counts: np.ndarray, y: np.ndarray) -> Iterator[tuple[Tree, float, Binned]]:
        bins = min(BINS, int(counts.sum()))
        used = counts > 0
        own, weights = np.ones(len(y)), None
        for turn in range(self.rounds):
            rows = values.binned(counts * own, bins)
            tree = grow(rows, *rows.sums(counts * own, y), self.depth, min_leaf=0)  # weights may be below 1
            missed = np.abs(y - tree.prediction[tree.leaves(rows.codes)][rows.cell])
            worst = missed[used].max()
            weights = counts * own
            loss = float((weights * missed).sum() / weights.sum() / worst) if worst else 0.0
            if loss >= 0.5 and turn:
                return
            if loss == 0.0 or loss >= 0.5:
                yield tree, 1.0, rows
                return
            beta = loss / (1.0 - loss)
            yield tree, self.rate * float(np.log(1.0 / beta)), rows
            # Divided by a number of this round, so that the weights stay near 1 on average.
            own = np.where(used, own * beta ** ((1.0 - missed / worst) * self.rate) / beta**0.5, 1.0)


def weighted_median(predictions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of every column, the smallest value at which half of the weight is reached."""
    order = np.argsort(predictions, axis=0, kind="stable")
    reached = np.cumsum(weights[order], axis=0) >= weights.sum() / 2
    return np.take_along_axis(predictions, np.take_along_axis(order, reached.argmax(axis=0)[None], 0), 0)[0]


Recipe = Forest | Single | Boosted | Adaptive


@dataclass
class Merged:
    """Different rows of features, target and fold, ordered by them, and how often each occurs."""

    values: Values
    y: np.ndarray
    counts: np.ndarray
    fold: np.ndarray

    def training(self, fold: int | None) -> np.ndarray:
        """The copies of every row outside a fold; of rows that differ in their fold only, the first stands for all."""
        counts = self.counts if fold is None else np.where(self.fold != fold, self.counts, 0.0)
        change = np.diff(self.y) != 0
        for places in self.values.places:
            change |= np.diff(places) != 0
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        out = np.zeros(len(counts))
        out[starts] = np.add.reduceat(counts, starts)
        return out

    def binned(self, fold: int | None) -> Binned:
        counts = self.training(fold)
        return self.values.binned(counts, min(BINS, int(counts.sum())))

    def summed(self, recipe: Recipe, fold: int | None, first: int, last: int) -> np.ndarray:
        """Predictions (points by rows) of a recipe fitted outside a fold; of a forest, sums over the trees from ``first`` to ``last``."""
        counts = self.training(fold)
        if not counts.any():
            raise ValueError("no rows to fit")
        if isinstance(recipe, Adaptive):
            parts = [(tree.prediction[tree.leaves(rows.codes)][rows.cell], weight) for tree, weight, rows in recipe.grown(self.values, counts, self.y)]
            weights, out = np.array([w for _, w in parts]), np.empty((1, len(self.y)))
            for a in range(0, len(self.y), MEDIAN_ROWS):
                out[0, a : a + MEDIAN_ROWS] = weighted_median(np.stack([p[a : a + MEDIAN_ROWS] for p, _ in parts]), weights)
            return out
        rows = self.binned(fold)
        if isinstance(recipe, Single):
            tree = recipe.grown(rows, counts, self.y)
            return tree.prediction[tree.leaves(rows.codes)][rows.cell][None]
        if isinstance(recipe, Boosted):
            return sum(weight * tree.prediction[tree.leaves(rows.codes)] for tree, weight in recipe.grown(rows, counts, self.y))[rows.cell][None]
        places = sorted({(c.depth, c.split) for c in recipe.points()})
        sums = np.zeros((len(places), rows.codes.shape[1]))
        for tree in recipe.grown(rows, counts, self.y, first, last):
            leaf = tree.leaves(rows.codes)
            for i, (depth, split) in enumerate(places):
                sums[i] += tree.stopped(depth, split)[leaf]
        return sums[:, rows.cell]


#: Rows whose boosted predictions are ordered at a time.
MEDIAN_ROWS = 20_000
