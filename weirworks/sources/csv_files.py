"""Headers of CSV files, and whole rows of files whose quoted fields hold line breaks, read in blocks.

A line break ends a row only where an even number of quotes stands before it. So one pass counts the quotes of every block of
every file, a running sum over blocks tells which blocks begin within quotes, and in a second pass each task finds the first real
border of its block by itself. Rows that lie across blocks leave one piece for each block; only these pieces are grouped.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirworks.session import ship_code

#: Headers read at the same time.
READERS = 16
#: Kinds of rows of the second pass: a whole row; the first, a middle, the last piece of a row across blocks.
WHOLE, FIRST, MIDDLE, LAST = range(4)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files below a path or pattern, without those that begin with "_" or "."; on any file system that Spark reads."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    start = hadoop.Path(path)
    system = start.getFileSystem(context._jsc.hadoopConfiguration())
    found = []
    for top in system.globStatus(start) or []:
        listing = system.listFiles(top.getPath(), True)
        while listing.hasNext():
            status = listing.next()
            parts = status.getPath().toString().removeprefix(top.getPath().toString()).split("/")
            if status.getLen() and not any(p.startswith(("_", ".")) for p in [*parts, status.getPath().getName()]):
                found.append(status.getPath().toString())
    return sorted(found)


def _header(spark: SparkSession, file: str) -> str:
    """The first row of a file; the driver reads that row only."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(file)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        row = reader.readLine() or ""
        while row.count('"') % 2 and (line := reader.readLine()) is not None:
            row += "\n" + line
        return row.removeprefix("\ufeff")
    finally:
        stream.close()


def by_header(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(names, files) for every different header below ``path``, in the order of their first files.

    Empty names become ``_c`` and their place, and names that repeat get their place added, as Spark does.
    """
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(f"no CSV files at {path}")
    with ThreadPool(READERS) as pool:
        headers = pool.map(lambda f: _header(spark, f), files)
    groups: dict[str, list[str]] = {}
    for file, header in zip(files, headers):
        groups.setdefault(header, []).append(file)
    return [(_names(header), members) for header, members in groups.items()]


def _names(header: str) -> list[str]:
    cells = next(csv.reader([header], doublequote=True), [])
    lowered = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, block, value): the lines of every block, in order within a task."""
    return spark.read.option("lineSep", "\n").text(list(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def within_quotes(spark: SparkSession, files: Sequence[str]) -> dict[str, set[int]]:
    """The blocks of each file that begin within quotes.

    Comes to the driver as one number for each such block, some bytes for the many megabytes that a block has.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = _lines(spark, files).groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found: dict[str, set[int]] = {}
    for row in odd.withColumn("before", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).where("before = 1").select("file", "block").collect():
        found.setdefault(row.file, set()).add(row.block)
    return found


def quoted_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(row): every row after the header of each file, with the line breaks of its quoted fields.

    Blocks have the session's ``spark.sql.files.maxPartitionBytes``; compressed files are one block each. Empty lines are no rows.
    """
    ship_code(spark)
    inside = spark.sparkContext.broadcast(within_quotes(spark, files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, open_, parts, kind, skip = None, False, [], WHOLE, False
        out: list[tuple] = []

        def leave(how: int) -> None:
            text = "\n".join(parts)
            parts.clear()
            if how in (WHOLE, LAST):
                text = text.removesuffix("\r")
            if how != WHOLE or text:
                out.append((at[0], at[1], how, text))

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "row"])

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    if parts:
                        leave(MIDDLE if kind == LAST else FIRST)
                    at = file, block
                    open_ = block in inside.value.get(file, ())
                    kind, skip = (LAST if open_ else WHOLE), block == 0
                parts.append(value)
                open_ ^= value.count('"') % 2 == 1
                if not open_:
                    if skip and kind == WHOLE:
                        parts.clear()
                        skip = False
                    else:
                        leave(kind)
                    kind = WHOLE
            if out:
                yield batch_of()
        if parts:
            leave(MIDDLE if kind == LAST else FIRST)
        if out:
            yield batch_of()

    found = _lines(spark, files).mapInArrow(run, "file string, block long, kind int, row string")
    # A row across blocks: from a first piece to the next last one. Only the pieces are read by this branch's grouping.
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    pieces = found.where(f"kind <> {WHOLE}").withColumn("number", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
    # Of one row and block there is one piece, so blocks are the order.
    ordered = F.array_sort(F.collect_list(F.struct("block", "row")))
    joined = pieces.groupBy("file", "number").agg(F.array_join(F.transform(ordered, lambda p: p["row"]), "\n").alias("row"))
    return found.where(f"kind = {WHOLE}").select("row").unionAll(joined.select(F.regexp_replace("row", "\r$", "").alias("row")))
