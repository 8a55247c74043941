"""Lineage cuts that outlive executors: tables written to the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir``. Only in local mode may it be
unset (unit tests on one machine): a local folder is then made and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Cuts made in each open scope, innermost last.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch root of this application; refused on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tidewheel-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = _OWN[0]
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: an eager, executor-loss-proof cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete cuts that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Cuts made inside are deleted at the end, but for those whose path is taken out of the list."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN[:] = [open_ for open_ in _OPEN if open_ is not made]  # lists of two scopes may be equal
        discard(spark, *made)
