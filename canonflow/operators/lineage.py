"""Lineage and exception tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.mapping import UNMAPPED, Mapping
from ..sources.archive import LINEAGE
from .dq import EXCEPTION, FIELDS

COLUMN_LINEAGE = "Lineage_ID string, Mapping_Reference_ID string, Job_ID string, Domain string, Source_Filename string, Source_Column_Name string, Source_Column_Normalised string, Canonical_Table string, Canonical_Column string, Match_Method string, Confidence_Score int, Was_Mandatory boolean, Met_Threshold boolean, LLM_Reasoning string, Lookup_Variant_Matched string, Archive_Lineage_ID string, Insert_Timestamp string"
EXCEPTION_COLUMNS = ["Exception_ID", "Job_ID", "Domain", *FIELDS, "Insert_Timestamp"]


def column_lineage_rows(mappings: list[Mapping], job_id: str, domain: str, filename: str, mapping_id: str, archive_id: str | None, stamp: str) -> list[tuple]:
    return [(uuid.uuid4().hex, mapping_id, job_id, domain, filename, x.source, x.normalised, x.table, x.column, x.method, x.confidence, x.mandatory, x.met, x.reasoning, x.variant, archive_id, stamp) for x in mappings]


def column_lineage(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, COLUMN_LINEAGE)


def archive_lineage(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, LINEAGE)


def mapping_exceptions(mappings: list[Mapping], blocked: list[tuple[str, str]], threshold: int, filename: str) -> list[tuple]:
    """LOW_CONFIDENCE_MAPPING for doubtful mandatory columns, UNMAPPED_MANDATORY for those that nothing maps to."""
    out = []
    mapped = {(x.table, x.column) for x in mappings if x.mapped}
    for x in mappings:
        if x.column != UNMAPPED and x.mandatory and x.confidence < threshold:
            out.append((filename, None, x.source, x.table, x.column, None, "LOW_CONFIDENCE_MAPPING", f"Source column '{x.source}' mapped to {x.table}.{x.column} with confidence {x.confidence} (threshold {threshold})"))
    return out + [(filename, None, None, t, c, None, "UNMAPPED_MANDATORY", f"{t}.{c} is mandatory and could not be mapped from any source column") for t, c in blocked if (t, c) not in mapped]


def file_exception(filename: str, kind: str, reason: str) -> tuple:
    return (filename, None, None, None, None, None, kind, reason)


def exceptions_table(spark: SparkSession, rows: list[tuple], found: list[DataFrame], job_id: str, domain: str, stamp: str) -> DataFrame:
    """All exceptions with their ids, which hash what they tell: a task that runs again gives the same."""
    parts = [spark.createDataFrame(rows, EXCEPTION), *found]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    key = F.sha2(F.concat_ws("\u0001", F.lit(job_id), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in FIELDS]), 256)
    return every.withColumns({"Exception_ID": key, "Job_ID": F.lit(job_id), "Domain": F.lit(domain), "Insert_Timestamp": F.lit(stamp)}).select(*EXCEPTION_COLUMNS)
