"""Tables for a session's own use in the folder that driver and executors share.

The folder is the one in ``spark.checkpoint.dir``.  What is written lies below a folder of the application's own, which goes
when the driver ends in order; ``clear`` removes it earlier.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_USED: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in local mode (tests), a temporary one that is set from now on.
    On a cluster an unset folder is an error, for no machine's own folder is seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's folder."""
    folder = f"{shared_folder(spark)}/attesta-{spark.sparkContext.applicationId}"
    if folder not in _USED:
        _USED[folder] = spark
        atexit.register(_forget, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage is cut and any executor can read it."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what this application has written here; results that still read it can't be read any more."""
    for folder in [f for f, s in _USED.items() if s.sparkContext.applicationId == spark.sparkContext.applicationId]:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _USED[folder]


def _forget(folder: str) -> None:
    spark = _USED.get(folder)
    if spark is None or spark.sparkContext._jsc is None:  # the session ended before
        return
    clear(spark)
