"""Projection of source tables onto canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: What Processing_System tells where a domain (output.processing_system) names nothing else.
PROCESSING_SYSTEM = "canonflow"


@dataclass(frozen=True)
class Origin:
    """Where rows come from."""

    filename: str
    file_format: str
    job_id: str
    mapping_id: str
    contributor: str | None = None
    system: str = PROCESSING_SYSTEM


def project_table(source: DataFrame, table: str, business: list[str], columns: dict[str, list[tuple[str, str, float]]], origin: Origin, stamp: str | None) -> DataFrame:
    """A canonical table of a source with Source_Row_Index: business columns (trimmed, null where unmapped), lineage, audit.

    columns: source column to (table, column, confidence). Of several sources of a column the most confident counts, then the first.
    stamp: the job's time as ISO text; None leaves the two time columns out.
    """
    best: dict[str, tuple[float, str]] = {}
    for name, targets in columns.items():
        for t, c, confidence in targets:
            if t == table and (c not in best or confidence > best[c][0]):
                best[c] = (confidence, name)
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    out = [strip(quoted(best[c][1])).alias(c) if c in best else F.lit(None).cast("string").alias(c) for c in business]
    out += [F.lit(origin.filename).alias("Source_Filename"), F.col("Source_Row_Index").cast("long"), F.lit(origin.contributor).cast("string").alias("Source_Contributor_ID"), F.lit(origin.file_format).alias("Source_File_Format"), F.lit(origin.mapping_id).alias("Mapping_Reference_ID")]
    out += [F.lit("ACTIVE").alias("Record_Status"), F.lit(1).alias("Record_Version")]
    out += [F.lit(stamp).alias(n) for n in ("Insert_Timestamp", "Last_Modified_Timestamp") if stamp is not None]
    out += [F.lit(origin.job_id).alias("Inserted_By_Job"), F.lit(origin.job_id).alias("Last_Modified_By_Job"), F.lit(origin.system).alias("Processing_System")]
    return source.select(*out)


def with_row_index(df: DataFrame, name: str = "Source_Row_Index") -> DataFrame:
    """Numbers rows from 1 in the order of partitions. The counts of the partitions, a row each, are all that meets in one task."""
    part = df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = part.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return part.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")
