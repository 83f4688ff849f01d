"""Fill rates, exception counts, tiers and the job's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_null

PASS_RATE, WARN_RATE = 95.0, 70.0
# Exception types by tier; all others are informational.
BLOCKING = ["UNMAPPED_MANDATORY", "LOW_CONFIDENCE_MAPPING", "MANDATORY_NULL", "PARSE_ERROR", "ENCODING_ERROR", "ARCHIVE_ERROR", "UNSUPPORTED_FILE_TYPE"]
DATA_QUALITY = ["TYPE_MISMATCH", "DUPLICATE_KEY", "REFERENTIAL_INTEGRITY_FAIL", "BUSINESS_RULE_FAIL"]


def null_counts(df: DataFrame, columns: list[str], tokens: list[str], by: list[str] | None = None, filled: list[str] | None = None) -> DataFrame:
    """(by..., column_name, total_rows, null_count) in long form, from one aggregation of one scan. filled: columns that count as filled throughout."""
    by = by or []
    sums = [F.sum((F.lit(False) if c in (filled or []) else is_null(F.col(c).cast("string"), tokens)).cast("long")).alias(c) for c in columns]
    wide = df.groupBy(*by).agg(F.count("*").alias("total_rows"), *sums)
    return wide.unpivot([*by, "total_rows"], columns, "column_name", "null_count").withColumn("null_count", F.coalesce("null_count", F.lit(0).cast("long")))


def status(rate: Column, pass_rate: float = PASS_RATE, warn_rate: float = WARN_RATE) -> Column:
    return F.when(rate >= pass_rate, "PASS").when(rate >= warn_rate, "WARN").otherwise("FAIL")


def with_fill(counts: DataFrame, pass_rate: float = PASS_RATE, warn_rate: float = WARN_RATE) -> DataFrame:
    """Adds fill_rate (percent, one place) and status to null_counts."""
    rate = F.when(F.col("total_rows") > 0, F.round((F.col("total_rows") - F.col("null_count")) * 100.0 / F.col("total_rows"), 1)).otherwise(0.0).cast("double")
    return counts.withColumn("fill_rate", rate).withColumn("status", status(F.col("fill_rate"), pass_rate, warn_rate))


def merged_fill(counts: DataFrame, keys: list[str], pass_rate: float = PASS_RATE, warn_rate: float = WARN_RATE) -> DataFrame:
    """The report of all files from the counts of each."""
    return with_fill(counts.groupBy(*keys).agg(F.sum("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count")), pass_rate, warn_rate)


def histogram(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("Exception_Type").agg(F.count("*").alias("n"))


def tier(kind: Column) -> Column:
    return F.when(kind.isin(BLOCKING), "Blocking").when(kind.isin(DATA_QUALITY), "DataQuality").otherwise("Informational")


def tiers(histogram_: DataFrame) -> DataFrame:
    return histogram_.groupBy(tier(F.col("Exception_Type")).alias("tier")).agg(F.sum("n").alias("n"))


def narrative(job_status: str, counts: dict[str, int]) -> str:
    """One line on a job: its status, then its exceptions by kind."""
    kinds = [("REFERENTIAL_INTEGRITY_FAIL", "referential integrity failure"), ("MANDATORY_NULL", "mandatory null"), ("DUPLICATE_KEY", "duplicate key")]
    parts = [(counts.get(k, 0), what) for k, what in kinds]
    named = {k for k, _ in kinds}
    parts.append((sum(n for k, n in counts.items() if k in BLOCKING and k not in named), "other blocking exception"))
    parts.append((sum(n for k, n in counts.items() if k in DATA_QUALITY and k not in named), "other data quality exception"))
    parts.append((sum(n for k, n in counts.items() if k not in BLOCKING and k not in DATA_QUALITY), "informational exception"))
    said = [f"{n} {what}{'s' * (n != 1)}" for n, what in parts if n]
    return f"{job_status}: {', '.join(said)}." if said else f"{job_status}: no exceptions."
