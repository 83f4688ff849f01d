"""Jobs: a batch of files becomes canonical tables, exceptions, lineage and reports.

The driver plans with metadata (headers, mappings, gates); rows are read,
projected and checked in one lazy plan a table.  The coerced tables and the
exceptions are written once each, and counts are taken from what was written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import ConfigError, DomainConfig, load_domain, overlay
from .operators import dq, lineage, project, report
from .plans import mapping, profiles
from .plans.providers import provider_of
from .sources import archive, files, tables
from .sources.files import InputFile


@dataclass
class JobResult:
    summary: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    exceptions: DataFrame | None = None
    column_lineage: DataFrame | None = None
    archive_lineage: DataFrame | None = None
    quality: dict = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    preview: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Inputs:
    parsed: list[tables.ParsedFile] = field(default_factory=list)
    failed: list[tuple[str, str, str]] = field(default_factory=list)
    lineage: list[tuple] = field(default_factory=list)


def read_inputs(spark: SparkSession, paths: list[str | InputFile], config: DomainConfig, job_id: str, stamp: str, staging: str) -> Inputs:
    """Each path's tables; archives are expanded first. A file that fails is told, and the others go on."""
    settings, out, queue = config.section("ingestion"), Inputs(), []
    for path in paths:
        file = path if isinstance(path, InputFile) else InputFile(str(path), PurePosixPath(str(path)).name)
        suffix = files.extension(file.name)
        try:
            if files.file_size(spark, file.path) > settings.get("max_uncompressed_size_mb", 2048) << 20 and suffix != ".parquet":
                raise files.UnsupportedFile("the file is larger than max_uncompressed_size_mb")
            if suffix == ".zip":
                if not settings.get("accept_archives", True):
                    raise files.UnsupportedFile("archives are not accepted")
                found = archive.Expander(spark, staging, settings, job_id, stamp).expand(file.name, files.read_all(spark, file.path))
                queue += found.files
                out.lineage += found.lineage
                out.failed += [(name, "ARCHIVE_ERROR", reason) for name, reason in found.refused]
            elif suffix in settings.get("blocked_extensions", []):
                out.failed.append((file.name, "ARCHIVE_ERROR", f"files of type {suffix} are blocked"))
            else:
                queue.append(file)
        except Exception as e:  # noqa: BLE001  one file's failure is its own
            out.failed.append((file.name, tables.error_type(e), str(e).splitlines()[0] if str(e) else type(e).__name__))
    for file in queue:
        try:
            out.parsed.append(tables.scan(spark, file, bool(settings.get("all_sheets"))))
        except Exception as e:  # noqa: BLE001
            out.failed.append((file.name, tables.error_type(e), str(e).splitlines()[0] if str(e) else type(e).__name__))
    return out


def checks_of(config: DomainConfig, table: str, sources: dict[str, str]) -> dq.Checks:
    quality = config.section("quality")
    types, found = quality.get("type_validation", {}), quality.get("duplicate_detection", {})
    return dq.Checks(
        table,
        {c: s.get("type", "string") for c, s in config.columns(table).items()},
        config.mandatory(table),
        found.get("keys", {}).get(table, []) if found.get("enabled", True) else [],
        config.null_tokens,
        types.get("numeric", {}).get("strip_chars"),
        sources,
        types.get("numeric", {}).get("enabled", True),
        types.get("date", {}).get("enabled", True),
    )


def fill_report(counts: DataFrame, config: DomainConfig) -> dict:
    """Nested report from (table, file, column, rows, nulls), a row per column: metadata in size."""
    quality = config.section("quality")
    limits = quality.get("dq_pass_fill_rate", 95), quality.get("dq_warn_fill_rate", 70)
    grade = lambda rate: "PASS" if rate >= limits[0] else "WARN" if rate >= limits[1] else "FAIL"
    per_file: dict = {}
    merged: dict = {}
    for r in counts.collect():
        for place in (merged, per_file.setdefault(r.file, {})):
            entry = place.setdefault(r.table, {"total_rows": 0, "columns": {}})
            column = entry["columns"].setdefault(r.column_name, {"total_rows": 0, "null_count": 0})
            column["total_rows"] += r.total_rows
            column["null_count"] += r.null_count
            entry["total_rows"] = max(entry["total_rows"], column["total_rows"])
    for place in (merged, *per_file.values()):
        for t, entry in place.items():
            for c, x in entry["columns"].items():
                rate = round((x["total_rows"] - x["null_count"]) / x["total_rows"] * 100, 1) if x["total_rows"] else 0.0
                x |= {"fill_rate": rate, "status": grade(rate), "mandatory": c in config.mandatory(t)}
    return {"tables": merged, "per_file_reports": per_file}


def written(mine: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Tables written once, so that each check reads columns instead of parsing and coercing the files again."""
    out = {}
    for t, df in mine.items():
        df.write.parquet(f"{folder}/{t}")
        out[t] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{t}")
    return out


def source_rows(parsed: list[tables.ParsedFile], per_file: dict) -> int:
    """Rows of all files: of a file that gave a table, as many as the table has from it; only others are counted."""
    names = [p.file.name for p in parsed]
    known = {n: max(x["total_rows"] for x in per_file[n].values()) for n in per_file if names.count(n) == 1}
    return sum(known[p.file.name] if p.file.name in known else p.rows.count() for p in parsed)


def run_job(
    spark: SparkSession,
    paths: list[str | InputFile],
    config: DomainConfig | str,
    output_dir: str,
    config_root: str | None = None,
    overrides: dict[str, tuple[str, str]] | None = None,
    contributor: str | None = None,
    provider: mapping.Provider | None = None,
    store: profiles.ProfileStore | None = None,
    table_format: str = "csv",
    scope: str = "file",
    exceptions_limit: int | None = None,
    provider_name: str | None = None,
    **thresholds,
) -> JobResult:
    """Runs a batch. Status: FAILED (bad configuration, or nothing readable), BLOCKED (mandatory columns miss in every file), SUCCESS_WITH_EXCEPTIONS or SUCCESS."""
    start, job_id = datetime.now(UTC), uuid.uuid4().hex[:12]
    stamp = start.isoformat()
    try:
        config = load_domain(config_root, config) if isinstance(config, str) else config
        config = overlay(config, contributor, provider=provider_name, **thresholds)
        provider = provider or provider_of(config)
    except (ConfigError, OSError, ValueError) as e:
        return JobResult({"Job_ID": job_id, "Job_Status": "FAILED", "Reason": str(e)})
    quality, folder = config.section("quality"), f"{output_dir.rstrip('/')}/{start:%Y%m%d}_{job_id}"
    inputs = read_inputs(spark, paths, config, job_id, stamp, f"{folder}/_staging")
    rows = [lineage.file_exception(name, kind, reason) for name, kind, reason in inputs.failed]
    lines: list[tuple] = []
    counted: dict[str, list[DataFrame]] = {}
    found: list[DataFrame] = []
    mapped: list[mapping.Mapping] = []
    blocked_all: list[tuple[str, str]] = []
    n_blocked = 0
    threshold = quality.get("mandatory_threshold", 80)
    integrity = quality.get("referential_integrity", {})
    rules = [r for spec in quality.get("business_rules", []) if (r := dq.declared_rule(spec))]
    canonical: dict[str, list[DataFrame]] = {}
    checks: dict[str, dq.Checks] = {}
    for parsed in inputs.parsed:
        own = dict(overrides or {})
        if store is not None and (match := store.match(parsed.header)).kind == "EXACT":
            own = {k: mapping.parse_target(v) for k, v in match.profile["overrides"].items()} | own
            store.used(match.profile["fingerprint"])
        mappings, mapping_id = mapping.Mapper(config, own, provider).all(parsed.header), uuid.uuid4().hex
        blocked = mapping.blocked_columns(mappings, config)
        name = parsed.file.name
        lines += lineage.column_lineage_rows(mappings, job_id, config.domain, name, mapping_id, parsed.file.archive_lineage_id, stamp)
        rows += lineage.mapping_exceptions(mappings, blocked, threshold, name)
        mapped += mappings
        blocked_all += blocked
        if parsed.dropped is not None:
            found.append(parsed.dropped.select(F.lit(name).alias("Source_Filename"), F.col("raw").alias("Raw_Value"), F.lit("PARSE_ERROR").alias("Exception_Type"), F.lit("row has more fields than the header and was dropped").alias("Reason")))
        if blocked and config.section("matching").get("auto_block_unmapped_mandatory", True):
            n_blocked += 1
            continue
        there = parsed.columns()
        columns = {there[k]: v for k, v in mapping.column_map(mappings).items()}
        origin = project.Origin(name, parsed.format, job_id, mapping_id, contributor, config.section("output").get("processing_system", project.PROCESSING_SYSTEM))
        mine, own_checks = {}, {}
        for t in mapping.active_tables(mappings):
            if t in config.tables:
                mine[t] = project.project_table(parsed.rows, t, list(config.columns(t)), columns, origin, stamp)
                own_checks[t] = checks_of(config, t, {x.column: x.source for x in reversed(mappings) if x.table == t})
        if not mine:
            continue
        if scope == "job":
            for t, df in mine.items():
                canonical.setdefault(t, []).append(df)
                checks[t] = own_checks[t]
            continue
        mine = written(mine, f"{folder}/_source/{mapping_id}")
        good = written({t: dq.coerce(df, own_checks[t]) for t, df in mine.items()}, f"{folder}/_source/{mapping_id}-coerced")
        good, bad = dq.run_checks(mine, own_checks, integrity.get("rules", []) if integrity.get("enabled", True) else [], rules, config.null_tokens, "file", good)
        found.append(bad)
        for t, df in good.items():
            counted.setdefault(t, []).append(df)
    if scope == "job" and canonical:
        merged = written({t: dq.union_all(spark, parts) for t, parts in canonical.items()}, f"{folder}/_source/all")
        good = written({t: dq.coerce(df, checks[t]) for t, df in merged.items()}, f"{folder}/_source/coerced")
        good, bad = dq.run_checks(merged, checks, integrity.get("rules", []) if integrity.get("enabled", True) else [], rules, config.null_tokens, "job", good)
        found.append(bad)
        counted = {t: [df] for t, df in good.items()}
    result = JobResult({})
    prefix = config.section("output")
    work = f"{folder}/_tables"
    fills = []
    for t, parts in counted.items():
        dq.union_all(spark, parts).write.parquet(f"{work}/{t}")
        result.tables[t] = spark.read.parquet(f"{work}/{t}")
        typed = [c for c, s in config.columns(t).items() if s.get("type") in ("numeric", "date")] if quality.get("legacy_fill") else []
        fills.append(report.null_counts(result.tables[t], list(config.columns(t)), config.null_tokens, ["Source_Filename"], typed).withColumnRenamed("Source_Filename", "file").withColumn("table", F.lit(t)))
    lineage.exceptions_table(spark, rows, found, job_id, config.domain, stamp).write.parquet(f"{work}/_exceptions")
    result.exceptions = spark.read.parquet(f"{work}/_exceptions")
    counts = {r.Exception_Type: r.n for r in report.histogram(result.exceptions).collect()}
    result.quality = (fill_report(dq.union_all(spark, fills), config) if fills else {"tables": {}, "per_file_reports": {}}) | {"exception_summary": counts, "total_exceptions": sum(counts.values())}
    total = sum(counts.values())
    if not inputs.parsed:
        status = "FAILED"
    elif n_blocked == len(inputs.parsed):
        status = "BLOCKED"
    else:
        status = "SUCCESS_WITH_EXCEPTIONS" if total or n_blocked else "SUCCESS"
    result.column_lineage, result.archive_lineage = lineage.column_lineage(spark, lines), lineage.archive_lineage(spark, inputs.lineage)
    methods = lambda *kinds: sum(x.method in kinds for x in mapped)
    by_tier = lambda kinds: sum(n for k, n in counts.items() if k in kinds)
    n_rows = {t: x["total_rows"] for t, x in result.quality["tables"].items()}
    result.summary = {
        "Job_ID": job_id, "Domain": config.domain, "Source_Filename": ", ".join(p.file.name for p in inputs.parsed) or ", ".join(n for n, _, _ in inputs.failed), "Job_Status": status, "Job_Narrative": report.narrative(status, counts),
        "Files_Processed": len(inputs.parsed), "Files_Failed": len({n for n, _, _ in inputs.failed}), "Total_Source_Rows": source_rows(inputs.parsed, result.quality["per_file_reports"]), "Total_Canonical_Rows_Written": sum(n_rows.values()), "Total_Exceptions": total,
        "Exceptions_Blocking": by_tier(report.BLOCKING), "Exceptions_DataQuality": by_tier(report.DATA_QUALITY), "Exceptions_Informational": total - by_tier(report.BLOCKING) - by_tier(report.DATA_QUALITY),
        "Columns_Mapped_Exact": methods(mapping.EXACT), "Columns_Mapped_Fuzzy": methods(mapping.FUZZY), "Columns_Mapped_LLM": methods(mapping.LLM, mapping.LLM_DISAMBIGUATED), "Columns_Unmapped": methods(mapping.NO_MATCH),
        "Mandatory_Columns_Blocked": len(blocked_all), "Blocked_Mandatory_Details": [f"{t}.{c}" for t, c in blocked_all], "Job_Start_Timestamp": stamp, "Job_End_Timestamp": datetime.now(UTC).isoformat(),
        "Config_Version": config.settings.get("_metadata", {}).get("config_version", "unknown"), "Config_Checksum": config.checksum(), "Canonical_Model_Version": config.model.get("_metadata", {}).get("version", "unknown"),
    }
    order = ["Source_Filename", "Source_Row_Index"]
    for t, df in result.tables.items():
        if n_rows.get(t):
            result.outputs[t] = sinks.write_table(df.orderBy(*order), f"{folder}/{prefix.get('canonical_prefix', 'canonical')}_{t}_{job_id}", table_format)
        result.preview[t] = df.orderBy(*order).limit(prefix.get("preview_rows", 20))
    if total:
        listed = sinks.listed(result.exceptions, [*order, "Exception_Type", "Canonical_Column"], exceptions_limit)
        result.outputs["exceptions"] = sinks.write_table(listed, f"{folder}/{prefix.get('exceptions_prefix', 'exceptions')}_{job_id}", table_format)
    result.outputs["column_lineage"] = sinks.write_table(result.column_lineage, f"{folder}/column_lineage_{job_id}", table_format)
    if inputs.lineage:
        result.outputs["archive_lineage"] = sinks.write_table(result.archive_lineage, f"{folder}/archive_lineage_{job_id}", table_format)
    result.outputs["dq_report"] = sinks.write_json(spark, result.quality, f"{folder}/{prefix.get('dq_report_prefix', 'dq')}_report_{job_id}.json")
    for left in ("_staging", "_source"):
        fs, path = sinks.file_system(spark, f"{folder}/{left}")
        fs.delete(path, True)
    result.outputs["summary"] = sinks.write_json(spark, result.summary, f"{folder}/job_summary_{job_id}.json")
    return result


def analyze(spark: SparkSession, paths: list[str], config: DomainConfig, overrides: dict[str, tuple[str, str]] | None = None, store: profiles.ProfileStore | None = None, provider: mapping.Provider | None = None) -> list[dict]:
    """Mapping preview: a scorecard per file, and which mandatory columns would block it. Writes nothing but use counts."""
    out = []
    for path in paths:
        file = InputFile(path, PurePosixPath(path).name)
        header = tables.header_of(spark, file)
        match = store.match(header) if store is not None else profiles.Match("NONE")
        own = dict(overrides or {})
        if match.kind == "EXACT":
            own = {k: mapping.parse_target(v) for k, v in match.profile["overrides"].items()} | own
            store.used(match.profile["fingerprint"])
        if match.kind == "EXACT" and match.profile.get("mappings") and not own:
            out.append({"file": file.name, "profile": match.kind, "scorecard": match.profile["mappings"], "blocked": []})
            continue
        mappings = mapping.Mapper(config, own, provider or provider_of(config)).all(header)
        out.append({"file": file.name, "profile": match.kind, "scorecard": mapping.scorecard(mappings), "blocked": [f"{t}.{c}" for t, c in mapping.blocked_columns(mappings, config)]})
    return out


def run_auto(spark: SparkSession, paths: list[str], config: DomainConfig, store: profiles.ProfileStore, output_dir: str, **options) -> dict:
    """Unattended run: only files whose header shape is saved are taken, each archive entry by itself."""
    decisions, accepted = [], []
    stamp = datetime.now(UTC).isoformat()
    for path in paths:
        name = PurePosixPath(path).name
        try:
            if files.extension(name) == ".zip":
                found = archive.Expander(spark, f"{output_dir.rstrip('/')}/_auto", config.section("ingestion"), "auto", stamp).expand(name, files.read_all(spark, path))
                decisions += [{"file": n, "status": "REJECTED", "reason": reason} for n, reason in found.refused]
                entries = found.files
            else:
                entries = [InputFile(path, name)]
            for entry in entries:
                good, reason = profiles.gate(store.match(tables.header_of(spark, entry)))
                decisions.append({"file": entry.name, "status": "ACCEPTED" if good else "REJECTED", "reason": reason})
                accepted += [entry] * good
        except Exception as e:  # noqa: BLE001  one file's failure is its own
            decisions.append({"file": name, "status": "REJECTED", "reason": str(e).splitlines()[0] if str(e) else type(e).__name__})
    job = run_job(spark, accepted, config, output_dir, store=store, **options) if accepted else None
    return {"decisions": decisions, "job": job, "job_summary": job.summary if job else None}
