"""Command line: run, analyze, auto, profiles and serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .config import PROVIDERS, load_domain, overlay
from .job import analyze, run_auto, run_job
from .plans.mapping import parse_overrides
from .plans.profiles import ProfileStore
from .service import Service, server


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="canonflow")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("run", "analyze", "auto"):
        p = sub.add_parser(name)
        p.add_argument("files", nargs="+")
        p.add_argument("--override", action="append", default=[], help="SOURCE=TABLE.Column")
        p.add_argument("--output-dir", default="artifacts")
        p.add_argument("--contributor-id")
        p.add_argument("--format", choices=["csv", "parquet"], default="csv")
        p.add_argument("--preview", action="store_true")
        p.add_argument("--provider", choices=PROVIDERS, help="instead of the configuration's")
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--output-dir", default="artifacts")
    p = sub.add_parser("profiles")
    p.add_argument("action", choices=["list", "delete", "save"])
    p.add_argument("key", nargs="?", help="a fingerprint or its beginning; for save, a file")
    for p in sub.choices.values():
        p.add_argument("--domain", default="trade")
        p.add_argument("--config-dir", default="domains")
        p.add_argument("--profile-dir", default="profiles")
    return out


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("canonflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = ProfileStore(a.profile_dir, a.domain)
    if a.command == "serve":
        server(Service(spark, a.config_dir, a.output_dir, a.profile_dir), a.host, a.port).serve_forever()
        return 0
    if a.command == "profiles":
        if a.action == "list":
            print(json.dumps(store.list(), indent=2))
            return 0
        if a.action == "delete":
            return 0 if store.delete(a.key or "?") else 1
        config = load_domain(a.config_dir, a.domain)
        card = analyze(spark, [a.key], config)[0]["scorecard"]
        print(store.save(a.key, [x["Source_Column"] for x in card if not x["Propagated"]], mappings=card))
        return 0
    if a.command == "analyze":
        print(json.dumps(analyze(spark, a.files, overlay(load_domain(a.config_dir, a.domain), provider=a.provider), parse_overrides(a.override), store), indent=2))
        return 0
    if a.command == "auto":
        out = run_auto(spark, a.files, load_domain(a.config_dir, a.domain), store, a.output_dir, contributor=a.contributor_id, table_format=a.format, provider_name=a.provider)
        print(json.dumps({k: out[k] for k in ("decisions", "job_summary")}, indent=2))
        job = out["job"]
    else:
        job = run_job(spark, a.files, a.domain, a.output_dir, a.config_dir, parse_overrides(a.override), a.contributor_id, store=store, table_format=a.format, provider_name=a.provider)
        print(json.dumps(job.summary, indent=2))
        for t, df in job.preview.items() if a.preview else ():
            print(t)
            df.show(truncate=False)
    return 0 if job is not None and job.summary["Job_Status"].startswith("SUCCESS") else 1


if __name__ == "__main__":
    sys.exit(main())
