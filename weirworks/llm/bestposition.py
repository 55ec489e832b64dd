"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are indexed in blocks: for each term that an item may ask for, the documents of the block that hold it, with their
counts. Items and blocks meet by a join on a salted block number, and each meeting is one search: a list for each term of the
item, highest impact first. Lists are read in step; a document that turns up is looked up directly in all other lists, which
also tells its positions there. In each list the best position is the last one before the first unseen one, so the impacts at
the best positions bound every document that was not met, more tightly than the positions last read. The search stops once
that bound is strictly below the k-th score, so ties at the k-th place are always met. The best of all blocks are merged.

Definitions: terms are ``TERM`` in the whole text, only A-Z lower-cased; a null or empty text has none. Weights and impacts are
the integers given in ``weight`` and ``impact``, sums are 64-bit. Each occurrence of a term in an item counts. Only scores
above 0 are returned, at most ``k`` for each item; equal scores by ascending id, null ids last, and rows that repeat an id are
ranked as rows of their own. An item row without terms has no result, item rows that repeat an item id are numbered
as one list. Without documents nothing is returned. Extra columns are ignored.

The index keeps the terms that pass a filter of fixed size, made of the items' terms: it may keep a few more terms, never
fewer. No item, list or index passes through the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.llm.packing import pack, unpack
from weirworks.session import scratch_path

#: What a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ENDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TIDY = bytes(32 if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of the filter of the items' terms: 1 MB.
FILTER_BITS = 23
MEMO = 400_000


@dataclass(frozen=True)
class SearchRules:
    k: int = 10
    #: Share of length in the norm of a document, in per cent.
    length_share: int = 75
    #: Postings and documents of an index block, and terms of an item block; a single document or item may have more.
    block_postings: int = 1_000_000
    block_docs: int = 16_384
    block_terms: int = 50_000
    #: Positions read in each list before the first look at the bound.
    step: int = 16


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TIDY).split()


def code_of(term: bytes) -> int:
    """A term as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def norms(lengths: np.ndarray, n_docs: int, all_terms: int, share: int) -> np.ndarray:
    return 100 - share + (share * lengths * n_docs) // max(all_terms, 1)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class _Codes(dict):
    """Codes of terms that pass the filter, None for the others."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> int | None:
        if len(self) >= MEMO:
            self.clear()
        code = code_of(term)
        slot = code & ((1 << FILTER_BITS) - 1)
        self[term] = code = code if self.bits[slot >> 3] >> (slot & 7) & 1 else None
        return code


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, item_row, code, times) of every item row."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = [Counter(map(code_of, terms_of(text))) for text in batch.column(2).to_pylist()]
            which = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int64))
            codes = pa.array([c for r in rows for c in r], pa.int64())
            times = pa.array([n for r in rows for n in r.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), codes, times], names=["item_id", "item_row", "code", "times"])

    return items.mapInArrow(run, f"item_id {kind}, item_row long, code long, times long")


def filter_of(codes: DataFrame) -> np.ndarray:
    """Bits of the codes in a filter of fixed size; Spark joins the bits of each byte first."""
    words = codes.selectExpr(f"shiftright(code & {(1 << FILTER_BITS) - 1}, 3) AS byte", "shiftleft(1, cast(code & 7 AS int)) AS bit")
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in words.groupBy("byte").agg(F.bit_or("bit").alias("bit")).collect():
        bits[row.byte] = row.bit
    return bits


_INDEX = "n_docs long, n_terms long, ids array<{kind}>, codes array<long>, held array<long>, body binary"


def index_blocks(docs: DataFrame, bits: np.ndarray, rules: SearchRules) -> DataFrame:
    """Index blocks of (doc_id, text) rows.

    ``n_docs`` and ``n_terms`` count documents with terms and all their terms; ``ids`` are the documents with postings;
    ``codes`` the terms, ``held`` how many documents hold each; ``body`` the lengths, and the postings of one term after the other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def block(ids, lengths, found, n_docs, n_terms):
        order = sorted({c for f in found for c in f})
        place = {c: i for i, c in enumerate(order)}
        sizes = [len(f) for f in found]
        owner = np.repeat(np.arange(len(found), dtype=np.int64), sizes)
        term = np.fromiter((place[c] for f in found for c in f), dtype=np.int64, count=len(owner))
        tf = np.fromiter((n for f in found for n in f.values()), dtype=np.int64, count=len(owner))
        by = np.lexsort((owner, term))
        held = np.bincount(term, minlength=len(order))
        body = pack(np.array(lengths, dtype=np.int64), owner[by], tf[by])
        return {"n_docs": n_docs, "n_terms": n_terms, "ids": ids, "codes": order, "held": held.tolist(), "body": body}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = _Codes(shared.value)
        ids, lengths, found, postings, n_docs, n_terms, schema = [], [], [], 0, 0, 0, None
        for batch in batches:
            schema = schema or pa.schema(
                [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("codes", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("body", pa.binary())]
            )
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                counts = Counter(map(known.__getitem__, terms))
                counts.pop(None, None)
                if counts:
                    ids.append(doc)
                    lengths.append(len(terms))
                    found.append(counts)
                    postings += len(counts)
                if postings >= rules.block_postings or len(ids) >= rules.block_docs:
                    yield pa.RecordBatch.from_pylist([block(ids, lengths, found, n_docs, n_terms)], schema=schema)
                    ids, lengths, found, postings, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield pa.RecordBatch.from_pylist([block(ids, lengths, found, n_docs, n_terms)], schema=schema)

    return docs.mapInArrow(run, _INDEX.format(kind=kind))


@dataclass
class ImpactList:
    """Documents of one term, highest impact first, with direct access by document."""

    docs: np.ndarray
    impacts: np.ndarray


def best_positions(lists: list[ImpactList], n_docs: int, k: int, step: int, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, entries read in order): the k best by score, then by ``rank_of``, among documents 0 to n_docs - 1."""
    lists = [x for x in lists if len(x.docs)]
    if not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    width = max(len(x.docs) for x in lists)
    # Direct access: the position of a document in each list; one past the end where it is missing.
    place = np.full((len(lists), n_docs), width, dtype=np.int64)
    value = np.zeros((len(lists), width + 1), dtype=np.int64)
    seen = np.ones((len(lists), width + 2), dtype=bool)
    order = np.full((len(lists), width), -1, dtype=np.int64)
    for i, x in enumerate(lists):
        n = len(x.docs)
        place[i, x.docs], value[i, :n], order[i, :n], seen[i, :n] = np.arange(n), x.impacts, x.docs, False
    seen[:, -1] = False
    met = np.zeros(n_docs, dtype=bool)
    scores = np.zeros(n_docs, dtype=np.int64)
    best = np.zeros(len(lists), dtype=np.int64)  # positions before it are all seen
    rows, depth, read = np.arange(len(lists))[:, None], 0, 0
    while depth < width:
        upto = min(depth + step, width)
        turned_up = np.unique(order[:, depth:upto])
        read += int((order[:, depth:upto] >= 0).sum())
        turned_up = turned_up[(turned_up >= 0)]
        new = turned_up[~met[turned_up]]
        if len(new):
            met[new] = True
            at = place[:, new]
            seen[rows, at] = True
            scores[new] = value[rows, at].sum(axis=0)
        depth, step = upto, min(2 * step, 4096)
        for i in range(len(lists)):
            best[i] += int(np.argmin(seen[i, best[i] :]))
        best = np.minimum(best, width + 1)
        found = np.flatnonzero(met)
        if len(found) >= k:
            # A list that is seen to its end holds no document that was not met.
            ended = best >= np.array([len(x.docs) for x in lists])
            bound = int(np.where(ended, 0, value[np.arange(len(lists)), np.maximum(best - 1, 0)]).sum())
            if not (best == 0).any() and bound < np.partition(scores[found], len(found) - k)[len(found) - k]:
                break
    found = np.flatnonzero(met & (scores > 0))
    top = found[np.lexsort((rank_of[found], -scores[found]))][:k]
    return top, scores[top], read


def search(
    docs: DataFrame, items: DataFrame, rules: SearchRules = SearchRules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    ship(spark)
    asked = scratch_path(spark, "asked")
    named = pick(items, item_id=item_col, text=item_text).select("item_id", F.monotonically_increasing_id().alias("item_row"), "text")
    item_terms(named).write.parquet(asked)
    terms = spark.read.parquet(asked)
    path = scratch_path(spark, "impacts")
    index_blocks(pick(docs, doc_id=id_col, text=text_col), filter_of(terms), rules).withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    index = spark.read.parquet(path)
    sums = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"), F.count("*").alias("blocks")).first()
    n_docs, all_terms = sums.n_docs, sums.n_terms

    held = index.select(F.explode(F.arrays_zip("codes", "held")).alias("t")).groupBy(F.col("t.codes").alias("code")).agg(F.sum("t.held").alias("held"))
    weighted = terms.join(held, "code").select("item_id", "item_row", "code", "times", F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("held") + 1))).cast("long").alias("w"))
    whole = weighted.where("w > 0").groupBy("item_id", "item_row").agg(F.collect_list(F.struct("code", F.expr("w * times").alias("w"))).alias("terms"))
    # Item blocks: items spread by their row; a copy of each for every four index blocks, so that no join key has many rows.
    salts = int(sums.blocks) // 4 + 1
    n_item_blocks = max(1, -(-terms.count() // rules.block_terms))
    blocks = whole.withColumn("item_block", F.pmod(F.xxhash64("item_row"), F.lit(n_item_blocks))).groupBy("item_block").agg(F.collect_list(F.struct("item_id", "terms")).alias("asked"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kept = index.where(F.size("ids") > 0).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    kept = kept.withColumn("item_block", F.explode(F.sequence(F.lit(0), F.lit(n_item_blocks - 1)).cast("array<long>")))
    met = kept.join(blocks, ["salt", "item_block"]).select("ids", "codes", "held", "body", "asked")
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, codes, counts = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                lengths, owner, tf = unpack(batch.column(3)[i].as_py())
                value = impact(tf, norms(lengths, n_docs, all_terms, rules.length_share)[owner])
                starts = np.concatenate([[0], np.cumsum(counts)])
                # Ids compare as such, null last.
                rank_of = np.empty(len(ids), dtype=np.int64)
                rank_of[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                lists: dict[int, ImpactList] = {}
                where = {c: t for t, c in enumerate(codes.tolist())}
                out_items, out_docs, out_scores = [], [], []
                for item in batch.column(4)[i].values.to_pylist():
                    mine = []
                    for term in item["terms"]:
                        t = where.get(term["code"])
                        if t is None:
                            continue
                        if t not in lists:
                            own = slice(starts[t], starts[t + 1])
                            by = np.argsort(-value[own], kind="stable")
                            lists[t] = ImpactList(owner[own][by], value[own][by])
                        mine.append(ImpactList(lists[t].docs, term["w"] * lists[t].impacts))
                    top, scores, _ = best_positions(mine, len(ids), rules.k, rules.step, rank_of)
                    out_items += [item["item_id"]] * len(top)
                    out_docs.append(top)
                    out_scores.append(scores)
                if out_items:
                    found = ids.take(pa.array(np.concatenate(out_docs)))
                    yield pa.RecordBatch.from_arrays([pa.array(out_items, batch.schema.field(4).type.value_type.field("item_id").type), found, pa.array(np.concatenate(out_scores))], names=["item_id", "doc_id", "score"])

    best = met.mapInArrow(run, f"item_id {item_kind}, doc_id {doc_kind}, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= rules.k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
t AS (SELECT r, unnest(ts) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
sums AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM d WHERE len(ts) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
w AS (
  SELECT item_id, q.term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM q JOIN df ON q.term = df.term, sums
),
s AS (
  SELECT item_id, d.doc_id, d.r,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN tf ON w.term = tf.term JOIN d ON d.r = tf.r, sums
  GROUP BY item_id, d.doc_id, d.r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
