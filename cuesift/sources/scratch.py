"""Folders for tables that outlive a plan but not the session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without it a folder of our own, on local masters only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="cuesift-")
        at = _own["dir"]
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; removed at exit."""
    path = f"{shared_dir(spark)}/cuesift-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """Spark's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            fs, at = file_system(spark, path)
            fs.delete(at, True)
        except Exception:  # the session may have ended before the interpreter
            return
