"""Writers: tables as CSV or Parquet, reports as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

BOM = b"\xef\xbb\xbf"


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a byte-order mark. Tasks write parts side by side; they are then appended to the file in their order."""
    spark, staging = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.option("header", False).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(staging)
    fs, folder = file_system(spark, staging)
    _, target = file_system(spark, path)
    stream = fs.create(target, True)
    try:
        header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns)
        stream.write(bytearray(BOM + header.encode() + b"\n"))
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = fs.open(status.getPath())
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(part, stream)
                part.close()
    finally:
        stream.close()
        fs.delete(folder, True)
    return path


def listed(exceptions: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Exceptions in the order in which they are written, the first `limit` if one is asked for."""
    out = exceptions.orderBy(*order)
    return out.limit(limit) if limit else out


def write_table(df: DataFrame, path: str, form: str = "csv") -> str:
    """As one CSV file, or as a Parquet folder, which is what large tables want."""
    if form == "csv":
        return write_csv(df, f"{path}.csv")
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    return f"{path}.parquet"


def write_json(spark: SparkSession, value: dict, path: str) -> str:
    fs, target = file_system(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, default=str).encode()))
    stream.close()
    return path
