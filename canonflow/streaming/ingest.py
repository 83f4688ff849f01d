"""Continuous ingestion: new files in a folder are run as jobs, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DomainConfig
from ..job import run_job


def ingest_folder(spark: SparkSession, folder: str, config: DomainConfig, output_dir: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """A query over a folder's new files; each micro-batch is one job. The checkpoint remembers the files that are done; a batch that runs again writes another job folder."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.*").load(folder).select("path")

    def batch(df: DataFrame, number: int) -> None:
        paths = [r.path for r in df.select("path").collect()]  # the names of one batch's files
        if paths:
            run_job(spark, sorted(paths), config, output_dir, **options)

    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_events(events: DataFrame, keys: list[str], time_column: str, delay: str = "1 hour") -> DataFrame:
    """A stream without rows whose keys came before, within a watermark that bounds what is remembered."""
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)
