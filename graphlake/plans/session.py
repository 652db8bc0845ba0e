"""Session settings that a query needs before it runs."""

from __future__ import annotations

import tempfile
import zipfile
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

Index = TypeVar("Index")


def shared_folder(spark: SparkSession) -> None:
    """Points checkpoint() at the cluster's shared folder; only a session that names none gets a local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "graphlake_workers.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_INDEXES: OrderedDict[tuple[str, str, str], object] = OrderedDict()
# Indexes kept at once; the one not used for longest goes first.
INDEXES = 8


def _state(spark: SparkSession, directory: str) -> int:
    """A hash of the names, sizes and times of the files in and one level below a directory, on any file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return 0
    seen = []
    for status in system.listStatus(path):
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        seen += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in inner]
    return hash(tuple(sorted(seen)))


def kept_index(spark: SparkSession, directory: str, name: str, build: Callable[[], Index]) -> Index:
    """An index of a data directory: built by the first query of the application that needs it, then read by others.

    Files that were added, rewritten or removed since make another index: names, sizes and times are part of the key.
    """
    shared_folder(spark)
    key = (spark.sparkContext.applicationId, directory, f"{name} {_state(spark, directory)}")
    if key not in _INDEXES:
        _INDEXES[key] = build()
    _INDEXES.move_to_end(key)
    while len(_INDEXES) > INDEXES:
        _INDEXES.popitem(last=False)
    return _INDEXES[key]  # type: ignore[return-value]
