"""Tables and markers in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset in a local run, a temporary one, which is then set. A cluster has to name one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
        there = f"file://{tempfile.mkdtemp(prefix='canonflow-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name not in use, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return

    atexit.register(drop)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files; else they stay until the driver's memory is next collected, which may be long after."""
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut, and a lost executor costs nothing that is written."""
    path = new_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_in = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what keep() wrote, once all that was made of it is written itself."""
    fs, p = hadoop_path(df.sparkSession, df.kept_in)
    fs.delete(p, True)
