"""Tables written to the shared folder: the way these operators cut lineage.

A written table survives the loss of any executor, unlike a local checkpoint.
The folder is the session's ``spark.checkpoint.dir``; only where that is unset
on a local master (tests) a folder of our own is made, elsewhere its absence is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="cuesift-")
        at = _own["dir"]
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed at exit."""
    path = f"{shared_dir(spark)}/cuesift-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, parted by the columns ``by``, and read it back; ``codec``: other than the session's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    _delete(df.sparkSession, df._path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to, else they wait for the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return
