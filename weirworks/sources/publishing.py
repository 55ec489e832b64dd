"""Published tables: every run writes a fresh version, and a small manifest makes all its tables visible at once.

    base/version=<id>/<table>/...   the tables of one run
    base/_manifests/000000000007    JSON: the version and its tables, readable once complete

A manifest is created under the next free number and never changed. Readers take the complete manifest with the highest
number, so they see all tables of the last finished run, whatever a run that died left behind. Of two runs that finish
together both are published, the later number last. A table that is read keeps its files until ``retire_versions``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from weirworks.session import drop_path
from weirworks.sources.sinks import write_table

_MANIFESTS = "_manifests"


def _store(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, base: str) -> list[int]:
    files, folder = _store(spark, f"{base}/{_MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def _manifest(spark: SparkSession, base: str, number: int) -> dict | None:
    """A manifest's content; None for one whose writer died before it was complete."""
    files, path = _store(spark, f"{base}/{_MANIFESTS}/{number:012d}")
    stream = files.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def _complete(spark: SparkSession, base: str) -> list[dict]:
    """All complete manifests, the newest first."""
    found = (_manifest(spark, base, number) for number in reversed(_numbers(spark, base)))
    return [manifest for manifest in found if manifest]


def new_version(base: str) -> str:
    """A fresh folder for the tables of one run; nothing reads it before ``commit_version``."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    return f"{base.rstrip('/')}/version={stamp}-{uuid.uuid4().hex[:12]}"


def commit_version(spark: SparkSession, base: str, version: str, tables: Mapping[str, str]) -> int:
    """Make the tables (name to path below ``version``) the current ones; returns the manifest's number."""
    base = base.rstrip("/")
    outside = [name for name, path in tables.items() if not path.startswith(f"{version}/")]
    if outside:
        raise ValueError(f"tables outside their version: {outside}")
    content = {"version": version[len(base) + 1 :], "tables": {name: path[len(version) + 1 :] for name, path in tables.items()}}
    number = max(_numbers(spark, base), default=0) + 1
    while True:
        files, path = _store(spark, f"{base}/{_MANIFESTS}/{number:012d}")
        try:
            stream = files.create(path, False)
        except Py4JJavaError:
            if not files.exists(path):
                raise
            number += 1  # another run was quicker
            continue
        try:
            stream.write(bytearray(json.dumps(content).encode("utf-8")))
        finally:
            stream.close()
        return number


def publish_tables(frames: Mapping[str, DataFrame], base: str, formats: Mapping[str, str] | None = None) -> dict[str, str]:
    """Write all frames as a new version (Parquet unless ``formats`` says otherwise) and publish them together."""
    if not frames:
        raise ValueError("nothing to publish")
    version = new_version(base)
    paths = {name: write_table(df, f"{version}/{name}", (formats or {}).get(name, "parquet")) for name, df in frames.items()}
    commit_version(next(iter(frames.values())).sparkSession, base, version, paths)
    return paths


def current_tables(spark: SparkSession, base: str, back: int = 0) -> dict[str, str]:
    """Name to path of the published tables, ``back`` publications before the last one."""
    base = base.rstrip("/")
    manifests = _complete(spark, base)
    if back >= len(manifests):
        raise FileNotFoundError(f"no such publication at {base}")
    manifest = manifests[back]
    return {name: f"{base}/{manifest['version']}/{table}" for name, table in manifest["tables"].items()}


def read_published(spark: SparkSession, base: str, table: str, back: int = 0, file_format: str = "parquet") -> DataFrame:
    """One published table, from the last publication or an earlier one."""
    return spark.read.format(file_format).load(current_tables(spark, base, back)[table])


def retire_versions(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete the tables of all but the last ``keep`` publications; returns the folders that went.

    Folders without a manifest stay: they may belong to a run that is still writing.
    """
    if keep < 1:
        raise ValueError("at least the current version stays")
    base = base.rstrip("/")
    manifests = _complete(spark, base)
    stay = {manifest["version"] for manifest in manifests[:keep]}
    gone = []
    for number in _numbers(spark, base):
        manifest = _manifest(spark, base, number)
        if manifest and manifest["version"] not in stay:
            # The manifest goes first, so that no reader is sent to a folder that is being deleted.
            drop_path(spark, f"{base}/{_MANIFESTS}/{number:012d}")
            drop_path(spark, f"{base}/{manifest['version']}")
            gone.append(f"{base}/{manifest['version']}")
    return gone
