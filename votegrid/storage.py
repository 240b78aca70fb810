"""Shared scratch space: written tables that cut lineage.

Operators that need a result twice write it as Parquet below the folder named by
``spark.checkpoint.dir`` and read it back.  Such a table survives lost executors,
gives the optimiser true sizes, and hides the producer's partitioning, so that a
later join shuffles both of its sides and stays open to adaptive skew handling.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder (tests, notebooks on one machine).
_fallback: dict[str, str] = {}
_open: list["Scratch"] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="votegrid-")
    return _fallback[app]


class Scratch:
    """A folder of staged tables of one operator call.

    Tables that the returned DataFrame reads lazily must outlive the call; they go
    when :func:`purge` is called or the driver ends.  The others go with :meth:`keep`
    as soon as all that was made from them is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/votegrid-{label}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader over the written table."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one staged table, or all."""
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        if not name and self in _open:
            _open.remove(self)


    def keep(self, *names: str) -> None:
        """Delete the staged tables of other names."""
        for name in set(self.names) - set(names):
            self.drop(name)
        self.names = [n for n in self.names if n in names]


def purge() -> None:
    """Delete every scratch folder of this driver."""
    for scratch in list(_open):
        with contextlib.suppress(Exception):
            scratch.drop()
    _open.clear()


atexit.register(purge)


def reachable(spark: SparkSession) -> None:
    """Let Python workers that share this machine find the package, wherever the
    driver was started.  Elsewhere ship it with ``--py-files`` or install it."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a staged table) has at most ``rows`` rows: the size check
    that every explicit broadcast in this library passes first."""
    return df.count() <= rows
