"""Intermediate results as written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: The folders that `settle` wrote, by the frame that reads them.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    A session of one machine without that setting gets a temporary one.  On a cluster it
    must be set: executors would write to folders of their own, and later reads miss them.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="leafmark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own(spark: SparkSession) -> str:
    """How the names of this application's folders begin."""
    return f"leafmark-{spark.sparkContext.applicationId}-"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    A frame that later steps use several times is then computed once, its lineage is cut,
    and a lost executor costs a reread.  `release` deletes the folder; those that a
    returned plan still reads stay until the caller calls `clear`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_own(spark)}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders of settled frames that nothing reads any more."""
    for df in frames:
        path = _folders.pop(df, None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> int:
    """Delete all folders that `settle` wrote for this application, and tell how many: when
    the results of its plans have been written or collected, nothing reads them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    own = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith(_own(spark))] if files.exists(folder) else []
    for path in own:
        files.delete(path, True)
    return len(own)
