"""Folders that driver and executors share, for files on their way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from .sinks import file_system


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under `spark.checkpoint.dir`, or under a temporary one in a local run, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='canonflow-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            fs, p = file_system(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return

    atexit.register(drop)
    return path


def put(spark: SparkSession, path: str, data: bytes) -> str:
    fs, p = file_system(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(data))
    stream.close()
    return path


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The data files that Spark wrote to a folder, in their order. The first partition leaves a file even if it has no rows; in formats without a header that file is empty, and no document of its format."""
    fs, p = file_system(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getLen())
    return [f"{folder}/{n}" for n in names if n.startswith("part-")]
