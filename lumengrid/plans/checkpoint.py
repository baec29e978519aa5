"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of our own, in local mode only."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumengrid-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    The lineage is cut, the rows survive a lost executor, later reads prune columns, and Spark knows
    the table's size, so that it can pick the join strategy by it. The job runs when this is called.
    """
    path = f"{shared_dir(df.sparkSession)}/lumengrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised table that nothing reads any more."""
    if path := _PATHS.pop(df, None):
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
