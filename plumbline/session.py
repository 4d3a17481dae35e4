"""Helpers bound to a SparkSession: shared folders, code shipping, table loading."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
_WRITTEN: list[tuple[SparkSession, str]] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it through sys.path only.

    On a cluster, ship the package with ``--py-files`` or install it; the entry below is then harmless.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    tidy removes the shuffle files of the writing job at its end; else they stay until the driver's garbage collection finds them unused.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if tidy:
        before = spark.conf.get(_TIDY, None)
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    _PATH_OF[out := spark.read.schema(df.schema).parquet(path)] = path
    return out


def dismiss(df: DataFrame) -> None:
    """Remove what materialize wrote for df; nothing may read it any more."""
    path = _PATH_OF.pop(df)
    _WRITTEN.remove((df.sparkSession, path))
    delete(df.sparkSession, path.rsplit("/", 1)[0])


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear() -> None:
    """Remove everything materialised so far; results that still read it are lost. For long sessions, between jobs."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        delete(spark, path.rsplit("/", 1)[0])


@atexit.register
def _at_exit() -> None:
    try:
        clear()
    except Exception:  # the session may have ended before; its folder is then the cluster's to clear
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
