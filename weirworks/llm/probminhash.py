"""Near-duplicate documents by probability Jaccard similarity of weighted word shingles.

1. Each text becomes its five-word shingles with their counts as weights. Every shingle starts a Poisson process whose rate
   is its weight; each arrival falls on one of ``registers`` registers, and a register remembers the shingle that arrived
   first. A shingle is done once its next arrival is later than the latest first arrival of all registers. Two registers
   agree with a chance of exactly the probability Jaccard similarity.
2. Identical texts are one representative. Representatives that share a band of ``rows`` registers are candidates.
3. Candidates are verified by the exact similarity of their shingles. A document is first compared with the smallest pivot
   of its buckets, then with the pivots of its large ones; members that are then connected need no more comparisons among
   themselves. In a bucket that is still divided, all pairs between different components follow: pair by pair in small
   buckets, in blocks against blocks in large ones, where only links leave the task and every cell of two blocks is dealt
   out by itself. No pair within a bucket is skipped unless it is connected already.
4. Links become classes: the smallest doc_id of a component.

Definitions: words are lower-cased runs of letters, digits and underscores. A text of one to four words is one shingle. A
null text is empty; texts without a word are alike only if identical. Rows with a null id have no class and are left out;
rows that repeat an id belong to one class if one of them does. An empty table gives an empty result. Extra columns are
ignored. Band recall at the threshold is 1 - 4.6e-8 per pair; every pair that shares a band is verified, in buckets of every size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship, text_of, wide_hash
from weirworks.llm.components import components
from weirworks.session import materialised

_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers.
MEMO = 500_000
#: Bytes kept of a shingle's hash in features: two shingles of a pair clash with a chance below 1e-6.
FEATURE_BYTES = 5


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    threshold: float = 0.8
    registers: int = 128
    rows: int = 4
    #: Buckets up to this size are compared pair by pair; members of a block in larger ones.
    small_bucket: int = 64
    block: int = 128

    @property
    def bands(self) -> int:
        return self.registers // self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = Words()


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of all shingles of a text in order, with repeats."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(hashes))
    rolled = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            rolled = mixed(rolled + _STEP) + hashes[i : i + len(rolled)]
    return mixed(rolled + np.uint64(size))


def weighted(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, counts), each shingle once."""
    return np.unique(shingles(text, words), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers: the first shingle to arrive at each register, as 32 bits of its hash; 0 for docs without any.

    All documents of a batch advance together: each turn gives every shingle that can still win its next arrivals.
    """
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, dtype=np.uint64)
    alive, clock, turn = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(alive):
        several = int(max(1, min(32, 60_000 // len(alive))))
        own = elements[alive]
        with np.errstate(over="ignore"):
            seeds = mixed(own[:, None] + _STEP * np.arange(turn + 1, turn + 1 + several, dtype=np.uint64)[None, :])
        gaps = -np.log(((seeds >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[alive, None]
        times = clock[alive, None] + np.cumsum(gaps, axis=1)
        place = (owner[alive] * registers)[:, None] + (mixed(seeds) % np.uint64(registers)).astype(np.int64)
        flat_times, flat_place = times.ravel(), place.ravel()
        np.minimum.at(first, flat_place, flat_times)
        won = flat_times == first[flat_place]
        winner[flat_place[won]] = np.repeat(own, several)[won]
        clock[alive] = times[:, -1]
        latest = first.reshape(docs, registers).max(1)
        alive = alive[clock[alive] < latest[owner[alive]]]
        turn += several
    return (winner & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(docs, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared shingles of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][in_a].astype(np.float64), b[1][in_b].astype(np.float64)
    total_a, total_b = float(a[1].sum()), float(b[1].sum())
    # With r = b_j / a_j: max(a_j / a_i, b_j / b_i) takes the second where r_j > r_i. Sorted by r, both parts are running sums.
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    after = np.searchsorted(ratio, ratio, side="right")
    sum_a = np.concatenate([[0.0], np.cumsum(x)])[after] + (total_a - x.sum())
    sum_b = (np.concatenate([[0.0], np.cumsum(y)])[-1] - np.concatenate([[0.0], np.cumsum(y)])[after]) + (total_b - y.sum())
    return float((1.0 / (sum_a / x + sum_b / y)).sum())


class Block:
    """Weighted shingles of several documents, to compare them with one document at a time."""

    def __init__(self, features: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(f[0]) for f in features])
        values = np.concatenate([f[0] for f in features])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owner = np.repeat(np.arange(len(features)), sizes)[order]
        self.counts = np.concatenate([f[1] for f in features]).astype(np.float64)[order]
        self.totals = np.array([float(f[1].sum()) for f in features])

    def similarities(self, one: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
        """``probability_jaccard`` of one document and each document of the block; 0 for those not asked for."""
        docs = len(self.totals)
        low, high = np.searchsorted(self.values, one[0], "left"), np.searchsorted(self.values, one[0], "right")
        width = high - low
        mine = np.repeat(np.arange(len(one[0])), width)
        at = np.arange(len(mine)) - np.repeat(np.cumsum(width) - width, width) + low[mine]
        wanted = asked[self.owner[at]]
        mine, at = mine[wanted], at[wanted]
        owner, x, y = self.owner[at], one[1][mine].astype(np.float64), self.counts[at]
        order = np.lexsort((y / x, owner))
        owner, x, y = owner[order], x[order], y[order]
        shared = np.bincount(owner, minlength=docs)
        begin = (np.cumsum(shared) - shared)[owner]
        # Running sums within a document, up to the last shingle with the same ratio.
        sums_x, sums_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
        ratio = y / x
        new = np.ones(len(x), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (ratio[1:] != ratio[:-1])
        group = np.cumsum(new) - 1
        last = np.append(np.flatnonzero(new)[1:], len(x))[group] if len(x) else group
        common_x, common_y = np.bincount(owner, x, docs), np.bincount(owner, y, docs)
        sum_a = sums_x[last] - sums_x[begin] + float(one[1].sum()) - common_x[owner]
        sum_b = common_y[owner] - (sums_y[last] - sums_y[begin]) + (self.totals - common_y)[owner]
        return np.bincount(owner, 1.0 / (sum_a / x + sum_b / y), docs)


def packed(text: str, words: int) -> bytes:
    """The weighted shingles of a text: distinct hashes, cut to a few bytes, and their counts where any is above 1."""
    values, counts = np.unique(shingles(text, words) >> np.uint64(64 - 8 * FEATURE_BYTES), return_counts=True)
    body = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FEATURE_BYTES].tobytes()
    return len(values).to_bytes(4, "little") + body + (counts.astype("<u4").tobytes() if (counts > 1).any() else b"")


def unpacked(feature: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(feature[:4], "little")
    end = 4 + size * FEATURE_BYTES
    wide = np.zeros((size, 8), dtype=np.uint8)
    wide[:, :FEATURE_BYTES] = np.frombuffer(feature[4:end], dtype=np.uint8).reshape(size, FEATURE_BYTES)
    counts = np.frombuffer(feature[end:], dtype="<u4") if len(feature) > end else np.ones(size, dtype=np.int64)
    return wide.view("<u8").ravel(), counts


def sign(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, digest, sig): text digest and registers of every document; sig is null for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                parts = [weighted(text or "", rules.words) for text in batch.column(2).to_pylist()]
                sizes = np.array([len(p[0]) for p in parts])
                owner = np.repeat(np.arange(len(parts)), sizes)
                elements = np.concatenate([p[0] for p in parts])
                weights = np.concatenate([p[1] for p in parts]).astype(np.float64)
                rows = signatures(elements, weights, owner, len(parts), rules.registers).view(np.int32)
                sig = pa.array([row if size else None for row, size in zip(rows, sizes, strict=True)], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sig], names=["doc_id", "digest", "sig"])

    source = docs.select("doc_id", wide_hash(text_of("text")).alias("digest"), "text")
    return source.mapInArrow(run, "doc_id long, digest binary, sig array<int>")


def _pair_links(pairs: DataFrame, features: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b): the roots of the pairs that reach the threshold. ``pairs``: a, b, a_root, b_root."""
    left = features.select(F.col("doc_id").alias("a"), F.col("feature").alias("fa"))
    right = features.select(F.col("doc_id").alias("b"), F.col("feature").alias("fb"))
    # A pivot is the b of many pairs: its rows are split over many tasks, which are better few where Python runs.
    return _verified(pairs.join(right, "b").join(left, "a").select("a_root", "b_root", "fa", "fb"), rules)


def _verified(rows: DataFrame, rules: NearRules) -> DataFrame:
    """The first two columns of the rows whose features, the next two, reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ok = [
                probability_jaccard(unpacked(x.as_py()), unpacked(y.as_py())) >= rules.threshold
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select([0, 1]).rename_columns(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _labels(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The bucket rows with the component of each document so far."""
    found = roots.select(F.col("node").alias("doc"), "root")
    return buckets.join(found, "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def _edges(roots: DataFrame) -> DataFrame:
    """Components as the links that hold them together."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _divided(labelled: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the bucket's size and pivot."""
    facts = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("doc").alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.min_by("root", "doc").alias("pivot_root"),
    ).where("low <> high")
    return labelled.join(materialised(facts.select("key", "size", "pivot", "pivot_root"), "divided-keys"), "key")


def _block_links(members: DataFrame, rules: NearRules) -> DataFrame:
    """Links (a, b) between the roots of different components of a large group, block against block.

    ``members``: doc, root, team, sig, feature. Every document outside its team's largest component meets every other.
    """
    sizes = members.groupBy("team", "root").agg(F.count(F.lit(1)).alias("n"))
    teams = sizes.groupBy("team").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    rows = members.join(materialised(teams, "teams"), "team")
    all_blocks = F.ceil(F.col("n") / rules.block).cast("int")
    open_blocks = F.ceil((F.col("n") - F.col("most")) / rules.block).cast("int")
    at = F.xxhash64("doc")
    column = F.pmod(at, all_blocks).cast("int")
    row = F.pmod(at, open_blocks).cast("int")

    def cell(opened: bool, i: Column, j: Column) -> Column:
        return F.struct(F.lit(opened).alias("opened"), i.alias("i"), j.alias("j"))

    right = F.transform(F.sequence(F.lit(0), open_blocks - 1), lambda i: cell(False, i, column))
    left = F.transform(F.sequence(F.lit(0), all_blocks - 1), lambda j: cell(True, row, j))
    cells = F.when(F.col("root") == F.col("main"), right).otherwise(F.concat(right, left))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ups, rest = group[group["opened"]], group[~group["opened"]]
        # Components so far: a link joins two, whose other pairs in this cell need no comparison.
        roots = np.concatenate([ups["root"], rest["root"]]).astype(np.int64)
        labels = roots.copy()
        if len(ups) and len(rest):
            mine, theirs = labels[: len(ups)], labels[len(ups) :]
            sig = np.stack(rest["sig"].to_numpy())
            block = Block([unpacked(f) for f in rest["feature"]])
            for k, (own, feature) in enumerate(zip(ups["sig"], ups["feature"], strict=True)):
                same = sig == np.asarray(own)[None, :]
                able = same.reshape(len(sig), rules.bands, rules.rows).all(2).any(1) & (theirs != mine[k])
                if able.any():
                    alike = block.similarities(unpacked(feature), able) >= rules.threshold
                    joined = np.append(theirs[alike], mine[k])
                    labels[np.isin(labels, joined)] = joined.min()
        out = sorted({(a, b) for a, b in zip(roots.tolist(), labels.tolist(), strict=True) if a != b})
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    part = ["team", "doc", "root", "sig", "feature"]
    spread = rows.select(*part, F.explode(cells).alias("cell")).select(*part, "cell.*")
    # Dealt by cell: rows that a join has dealt by team would count as grouped, and all cells of a team would be one task's.
    return spread.repartition("team", "i", "j").groupBy("team", "i", "j").applyInPandas(compare, "a long, b long")


def near_classes(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, is_kept): one row for each id; the smallest id of a class is kept."""
    spark = docs.sparkSession
    ship(spark)
    source = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialised(sign(source, rules), "signatures")
    # Stored before it is joined, here and below: a join of two plain exchanges is one whose hot keys can be split.
    least = materialised(signed.groupBy("digest").agg(F.min("doc_id").alias("rep")), "representatives")
    copies = signed.select("doc_id", "digest").join(least, "digest").select("doc_id", "rep")
    with ThreadPoolExecutor(1) as beside:  # two jobs at a time: one's last tasks leave cores to the other
        stored = beside.submit(inheritable_thread_target(spark)(materialised), copies, "copies")
        links = _near_links(source, signed, least, rules, beside)
        copies = stored.result()

    again = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionAll(again))
    every = copies.select("doc_id").distinct().join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    classes = every.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return classes.join(sizes, "class_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))


def _near_links(source: DataFrame, signed: DataFrame, least: DataFrame, rules: NearRules, beside: ThreadPoolExecutor) -> DataFrame:
    """(a, b): links that hold the components of the representatives together. ``beside`` runs jobs next to others."""
    reps = least.select(F.col("rep").alias("doc_id"))

    banded = signed.where("sig IS NOT NULL").select("doc_id", F.array(*[_band_key(i, rules) for i in range(rules.bands)]).alias("keys"))
    keys = banded.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("pivot")).where("n > 1")
    buckets = materialised(keys.join(materialised(shared.select("key", "pivot"), "shared"), "key"), "buckets")

    # Each document meets the smallest pivot of its buckets; its shingles are computed once, for all later comparisons.
    first = buckets.groupBy("doc").agg(F.min("pivot").alias("pivot"))
    features = materialised(_features(source, first, rules), "features")
    stars = features.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"), F.col("feature").alias("fa"))
    centres = features.where("is_pivot").select(F.col("doc_id").alias("b"), F.col("feature").alias("fb"))
    links = materialised(_verified(stars.join(centres, "b").select("a", "b", "fa", "fb"), rules), "links")

    # The other pivots of large buckets, where they could still join components.
    roots = components(links)
    labelled = _divided(_labels(buckets.select("key", "doc"), roots)).where(F.col("size") > rules.small_bucket)
    more = labelled.where("root <> pivot_root").select(
        F.col("doc").alias("a"), F.col("pivot").alias("b"), F.col("root").alias("a_root"), F.col("pivot_root").alias("b_root")
    )
    done = features.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    links = materialised(_pair_links(more.distinct().join(done, ["a", "b"], "left_anti"), features, rules), "links")

    # What is left of divided buckets: every pair between components.
    roots = components(_edges(roots).unionAll(links))
    left = materialised(_divided(_labels(buckets.select("key", "doc"), roots)), "divided")
    small = left.where(F.col("size") <= rules.small_bucket)
    pairs = small.alias("x").join(small.alias("y"), "key").where("x.doc < y.doc AND x.root <> y.root").select(
        F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.root").alias("a_root"), F.col("y.root").alias("b_root")
    )
    pair_links = beside.submit(
        inheritable_thread_target(source.sparkSession)(materialised), _pair_links(pairs.distinct(), features, rules), "links"
    )
    large = left.where(F.col("size") > rules.small_bucket)
    teams = components(large.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct())
    nodes = teams.unionAll(teams.select(F.col("root").alias("node"), "root").distinct())
    members = large.select("doc", "root").distinct().join(nodes.select(F.col("node").alias("doc"), F.col("root").alias("team")), "doc")
    sigs = signed.select(F.col("doc_id").alias("doc"), "sig")
    detailed = materialised(members, "members").join(sigs, "doc").dropDuplicates(["doc"]).join(features.select(F.col("doc_id").alias("doc"), "feature"), "doc")
    detailed = materialised(detailed, "detailed")
    block_links = materialised(_block_links(detailed, rules), "links")
    return _edges(roots).unionAll(pair_links.result()).unionAll(block_links)


def _band_key(band: int, rules: NearRules) -> Column:
    return F.xxhash64(F.lit(band), F.slice("sig", band * rules.rows + 1, rules.rows))


def _features(source: DataFrame, first: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, pivot, is_pivot, feature) of the documents that share a bucket, one row for each id."""
    pivots = first.select(F.col("pivot").alias("doc")).distinct().withColumn("is_pivot", F.lit(True))
    wanted = first.join(pivots, "doc", "left").select(F.col("doc").alias("doc_id"), "pivot", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([packed(text or "", rules.words) for text in batch.column(3).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["doc_id", "pivot", "is_pivot", "feature"])

    joined = source.join(wanted, "doc_id").select("doc_id", "pivot", "is_pivot", "text")
    return joined.mapInArrow(run, "doc_id long, pivot long, is_pivot boolean, feature binary")


def keep_one(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``: the rows of each class's smallest id, and the rows without an id."""
    gone = near_classes(docs, rules, id_col, text_col).where("NOT is_kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
