"""Session and storage helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "weirworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is left to spark-submit when omitted."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is configured, a single-machine session gets a folder of its own; on a cluster that would scatter the
    parts over the executors' disks, so it is refused there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weirworks-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, for the jobs that run Python on them."""
    application = spark.sparkContext.applicationId
    with _SHIPPING:  # fits run side by side
        if application in _SHIPPED:
            return
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="weirworks-code-")) / "weirworks_core.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, str(path.relative_to(package.parent)))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(application)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no frame reads any more, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table that one job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, for jobs that read it several times.

    Unlike a cache it survives lost executors, needs no release, and every reader fetches only its own columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame that several actions of one eager job read, and release it afterwards."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


#: Rows of a task of an iterative fit, unless the caller says otherwise.
ROWS_PER_TASK = 20_000


@contextmanager
def fit_input(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> Iterator[DataFrame]:
    """A kept frame for iterative fits, in one partition for each ``rows_per_task`` rows whatever the cluster.

    Forests bag by partition, so rows are spread by a hash of the whole row and sorted: a model depends on the rows and on
    ``rows_per_task`` only, not on cores or on how the rows arrive, and a key with many rows is spread too.
    """
    with reused(df) as kept:
        wanted = max(1, -(-kept.count() // rows_per_task))
        columns = [f"`{c.replace('`', '``')}`" for c in [key, *[c for c in df.columns if c != key]]]
        with reused(kept.repartition(wanted, *columns).sortWithinPartitions(*columns)) as spread:
            yield spread
