"""Line deduplication over levelled, sorted runs of line hashes.

Runs are bucketed by the key's hash and sorted within each bucket, so that runs meet by merging: no join of a run with a run or
with a batch shuffles or sorts anything. Each batch of documents becomes one row per line key, with the number of documents
that hold it and the largest of their ids. A merge anti-join with the runs tells new keys, which form a run of their own;
merge semi-joins tell known ones, which form a run of updates. Once ``fanout`` runs share a level they are merged, two at a time, into
one run of the next level, so a key is rewritten once for each level only. Counts of different batches add up, because a
document is in one batch. A line goes once the whole corpus has been counted, since the largest id of all decides: one join of
the lines with the keys that the runs hold often enough lists what each document loses.

Definitions: a null text is an empty one; an empty text is one empty line. Rows that share an id are one document when
documents are counted, and every such row loses the same lines. Rows with a null id are not counted and keep all lines.
Keys repeated within one document count once; the document that keeps a key keeps all its lines with it. An empty table
gives an empty result. Extra columns are ignored. What a text loses is looked up by hash, so a text of many lines that loses many
costs no more than reading both.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm.common import pick, quoted, ship, text_of, wide_hash
from weirworks.session import drop_path, materialised, scratch_path

#: The characters stripped from both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 20
    min_docs: int = 3
    batches: int = 4
    fanout: int = 2


def line_key(line: Column) -> Column:
    """The stripped line with A to Z lower-cased, other letters as they are."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, rules: LineRules, id_col: str, text_col: str) -> DataFrame:
    """(batch, hash, doc_id): a row for each different long line of each document."""
    lines = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").select(
        "doc_id", F.explode(F.array_distinct(split_lines(text_of("text")))).alias("line")
    )
    keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(F.length("key") >= rules.min_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(rules.batches)).cast("int")
    return keys.select(batch.alias("batch"), wide_hash("key").alias("hash"), "doc_id")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def _added(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Two runs in one: counts added, the larger keeper of both."""
    a, b = left.alias("a"), right.alias("b")
    count = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
    joined = a.join(b.hint("merge"), F.col("a.hash") == F.col("b.hash"), how)
    return joined.select(F.coalesce("a.hash", "b.hash").alias("hash"), count.alias("n_docs"), F.greatest("a.keeper", "b.keeper").alias("keeper"))


@dataclass
class LineRuns:
    """The runs in one folder, by level: of new keys and of updates. A run is complete once written; a failed merge leaves its inputs valid.

    Runs are tables of this session, since only tables keep their buckets; ``drop`` ends them.
    """

    spark: SparkSession
    folder: str
    fanout: int = 2
    buckets: int | None = None
    levels: dict[int, list[str]] = field(default_factory=dict)
    updates: dict[int, list[str]] = field(default_factory=dict)
    _made: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        self._made.append(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.folder}/{name}")
        self._made.remove(name)

    def _names(self, runs: dict[int, list[str]]) -> list[str]:
        return [name for level in sorted(runs) for name in runs[level]]

    def _put(self, runs: dict[int, list[str]], name: str) -> None:
        """A new run at the lowest level, then the merges that are due."""
        runs.setdefault(0, []).append(name)
        level = 0
        while len(runs.get(level, [])) >= self.fanout:
            first, *rest = runs.pop(level)
            for other in rest:
                merged = self._write(_added(self.spark.table(first), self.spark.table(other), "full"))
                self._drop(first)
                self._drop(other)
                first = merged
            runs.setdefault(level + 1, []).append(first)
            level += 1

    def new_keys(self, batch: DataFrame) -> DataFrame:
        """The rows of a bucketed batch whose key no run holds."""
        for name in self._names(self.levels):
            batch = batch.join(self.spark.table(name).select("hash").hint("merge"), "hash", "left_anti")
        return batch

    def known_keys(self, batch: DataFrame) -> DataFrame | None:
        """The rows of a bucketed batch whose key a run holds; a key is in one run of new keys only."""
        found = [batch.join(self.spark.table(name).select("hash").hint("merge"), "hash", "left_semi") for name in self._names(self.levels)]
        return reduce(DataFrame.unionAll, found) if found else None

    def add(self, lines: DataFrame) -> None:
        """Splits the keys of one batch of (hash, doc_id) into new and known ones, each a sorted run."""
        once = lines.groupBy("hash", "doc_id").agg(F.lit(1).cast("long").alias("n_docs"))  # copies of a row count once
        summary = self._write(_merged(once.withColumnRenamed("doc_id", "keeper")).repartition(self.buckets, "hash"))
        batch = self.spark.table(summary)
        known = self.known_keys(batch)
        fresh = self._write(self.new_keys(batch))
        if known is not None:
            self._put(self.updates, self._write(known.repartition(self.buckets, "hash")))
        self._put(self.levels, fresh)
        self._drop(summary)

    def frequent(self, min_docs: int) -> DataFrame:
        """(hash, keeper) of the keys in at least ``min_docs`` documents over all runs."""
        parts = []
        for name in self._names(self.levels):
            run = self.spark.table(name)
            for update in self._names(self.updates):
                run = _added(run, self.spark.table(update), "left")
            parts.append(run)
        return reduce(DataFrame.unionAll, parts).where(F.col("n_docs") >= min_docs).select("hash", "keeper")

    def drop(self) -> None:
        """Delete all runs; nothing may read them any more."""
        for name in list(self._made):
            self._drop(name)


def drop_lists(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes): the line keys that each document loses; a row only for documents that lose some."""
    spark = docs.sparkSession
    staged = scratch_path(spark, "lines")
    hashed_lines(docs, rules, id_col, text_col).write.partitionBy("batch").parquet(staged)
    schema = f"hash binary, doc_id {docs.schema[id_col].dataType.simpleString()}, batch int"
    lines = spark.read.schema(schema).parquet(staged)
    runs = LineRuns(spark, scratch_path(spark, "line-runs"), rules.fanout)
    for batch in range(rules.batches):
        runs.add(lines.where(F.col("batch") == batch))
    # Stored before it is joined: a join of two plain exchanges is one whose hot keys can be split.
    often = materialised(runs.frequent(rules.min_docs), "frequent-lines")
    runs.drop()
    lost = lines.join(often, "hash").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))


def _kept(rules: LineRules) -> Callable[..., Column]:
    """A function of (text, hashes): the text without the lines whose key is in ``hashes``, and how many stay; null for null hashes."""
    smallest, blanks = rules.min_chars, BLANKS.encode()

    def kept(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, hashes):
            if gone is None:
                out.append((None, None))
                continue
            gone = {bytes(h) for h in gone}
            stay = []
            for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                key = line.strip(blanks)
                # Code points are bytes but for those that continue one.
                long = len(key) >= smallest and len(key) - sum(0x80 <= c < 0xC0 for c in key[: 4 * smallest]) >= smallest
                if not (long and hashlib.md5(key.lower()).digest() in gone):
                    stay.append(line)
            out.append((b"\n".join(stay).decode("utf-8", "surrogatepass"), len(stay)))
        return pd.DataFrame(out, columns=["text", "n"])

    return F.pandas_udf(kept, "text string, n long")


def _without_lost(docs: DataFrame, lost: DataFrame, rules: LineRules, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """The documents with what they lose, and the struct (text, n) of what stays; null where nothing goes."""
    ship(docs.sparkSession)
    joined = docs.join(lost, docs[quoted(id_col)] == lost["doc_id"], "left")
    return joined, _kept(rules)(F.when(lost["hashes"].isNotNull(), text_of(docs[quoted(text_col)])), lost["hashes"])


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its dropped lines. A null text stays null."""
    lost = drop_lists(docs, rules, id_col, text_col)
    joined, kept = _without_lost(docs, lost, rules, id_col, text_col)
    text = F.when(lost["hashes"].isNull(), docs[quoted(text_col)]).otherwise(kept["text"])
    return joined.select(*[text.alias(c) if c == text_col else docs[quoted(c)] for c in docs.columns])


def line_digest(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    rows = pick(docs, id=id_col, text=text_col)
    joined, kept = _without_lost(rows, drop_lists(docs, rules, id_col, text_col), rules, "id", "text")
    counted = joined.select(
        F.col("id").alias("doc_id"),
        F.size(split_lines(text_of("text"))).cast("long").alias("n_lines"),
        text_of("text").alias("text"),
        kept.alias("kept"),
    )
    return counted.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.col("n_lines") - F.col("kept.n"), F.lit(0)).alias("n_dropped"),
        F.sha2(F.coalesce("kept.text", "text").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.pos, o.keeper IS NOT NULL AND o.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN often o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
