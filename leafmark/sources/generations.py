"""Tables that are replaced whole without disturbing their readers.

A table is a folder of generations `v=0`, `v=1`, ...; a generation counts once Spark has
marked it as written.  A write that fails leaves the one before as it was, a table can be
written from itself, and a plan made before the write still finds its files, as the
generation before the newest stays until the next write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NEWEST = "v"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str, kind: str = NEWEST, complete: bool = True) -> list[str]:
    """What follows `kind=` in the names of the folders below `path`; only of those that
    were written in full, if `complete`."""
    files, folder = _files(spark, path)
    found = []
    for status in files.listStatus(folder) if files.exists(folder) else []:
        at = status.getPath()
        own, _, rest = at.getName().partition("=")
        if own == kind and rest and (not complete or files.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))):
            found.append(rest)
    return found


def numbers(spark: SparkSession, path: str, kind: str = NEWEST, complete: bool = True) -> list[int]:
    return sorted(int(n) for n in names(spark, path, kind, complete))


def drop(spark: SparkSession, path: str, *folders: str) -> None:
    files, folder = _files(spark, path)
    for name in folders:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)


def replace(df: DataFrame, path: str) -> None:
    """Make `df` the table's newest generation; the one before stays, older ones go."""
    spark = df.sparkSession
    before = numbers(spark, path, complete=False)
    done = numbers(spark, path)
    df.write.parquet(f"{path}/{NEWEST}={(before or [-1])[-1] + 1}")
    kept = done[-1:]
    drop(spark, path, *(f"{NEWEST}={n}" for n in before if n not in kept))


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest generation; without one, an empty table."""
    done = numbers(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{NEWEST}={done[-1]}") if done else spark.createDataFrame([], schema)
