"""HTTP service over the engine: uploads become jobs or previews, answers are JSON, and a page holds a form for both.

GET /, GET /api/v1/health, /domains and /profiles, DELETE /api/v1/profiles/KEY, POST /api/v1/jobs/run, /jobs/analyze and /jobs/auto
(multipart forms with files; fields as in FIELDS).
"""

from __future__ import annotations

import json
import uuid
from email.parser import BytesParser
from email.policy import HTTP
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePosixPath
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from .config import ConfigError, DomainConfig, discover_domains, load_domain, overlay
from .job import analyze, run_auto, run_job
from .plans.mapping import parse_overrides
from .plans.profiles import ProfileStore
from .staging import put, shared_folder

#: Fields of a form that overlay the configuration, and how each is read.
FIELDS = {"llm_provider": ("provider", str), "llm_accept_threshold": ("confidence_accept_threshold", int), "mandatory_threshold": ("mandatory_threshold", int), "fuzzy_min_similarity": ("fuzzy_min_similarity", lambda x: int(x) / 100)}
MOST_BYTES = 2 << 30
PAGE = """<!DOCTYPE html><html lang="en"><meta charset="utf-8"><title>canonflow</title><h1>canonflow</h1>
<form method="post" enctype="multipart/form-data" action="/"><p><input type="file" name="files" multiple required>
<select name="domain">{domains}</select> <label>Overrides (JSON) <input name="overrides" value="{{}}"></label>
<button name="do" value="analyze">Analyze mapping</button> <button name="do" value="run">Run</button></form>{result}</html>"""


class Refused(ValueError):
    """A request that can't be served, with its HTTP status."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def read_form(content_type: str, body: bytes) -> tuple[dict[str, str], list[tuple[str, bytes]]]:
    """(fields, files with their names) of a multipart form."""
    if not content_type.lower().startswith("multipart/form-data"):
        raise Refused(415, "a multipart form is needed")
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    fields, found = {}, []
    for part in message.iter_parts():
        content, name = part.get_payload(decode=True) or b"", part.get_param("name", header="content-disposition")
        if filename := part.get_filename():
            found.append((PurePosixPath(filename.replace("\\", "/")).name, content))
        elif name:
            fields[name] = content.decode("utf-8", "replace")
    return fields, found


class Service:
    """What the service does, apart from HTTP."""

    def __init__(self, spark: SparkSession, config_dir: str, output_dir: str, profile_dir: str):
        self.spark, self.config_dir, self.output_dir, self.profile_dir = spark, config_dir, output_dir, profile_dir

    def _config(self, fields: dict[str, str]) -> DomainConfig:
        domain = fields.get("domain") or "trade"
        if domain not in discover_domains(self.config_dir):
            raise Refused(404, f"no domain {domain!r}")
        try:
            return overlay(load_domain(self.config_dir, domain), fields.get("contributor_id"), **{own: read(fields[x]) for x, (own, read) in FIELDS.items() if fields.get(x)})
        except (ConfigError, ValueError) as e:
            raise Refused(422, str(e)) from e

    def _store(self, domain: str) -> ProfileStore:
        return ProfileStore(self.profile_dir, domain)

    def jobs(self, kind: str, fields: dict[str, str], uploads: list[tuple[str, bytes]]) -> dict | list:
        if not uploads:
            raise Refused(422, "no file was sent")
        config = self._config(fields)
        try:
            overrides = parse_overrides(fields.get("overrides"))
        except ValueError as e:
            raise Refused(422, f"overrides: {e}") from e
        folder = shared_folder(self.spark, "uploads")
        paths = [put(self.spark, f"{folder}/{uuid.uuid4().hex[:8]}_{name}", content) for name, content in uploads]
        store, more = self._store(config.domain), {"contributor": fields.get("contributor_id")}
        if kind == "analyze":
            return analyze(self.spark, paths, config, overrides, store if fields.get("check_profiles", "true").lower() != "false" else None)
        if kind == "auto":
            out = run_auto(self.spark, paths, config, store, self.output_dir, **more)
            return {k: out[k] for k in ("decisions", "job_summary")}
        job = run_job(self.spark, paths, config, self.output_dir, overrides=overrides, store=store, **more)
        return job.summary | {"output_files": job.outputs}

    def profiles(self, domain: str) -> list[dict]:
        return self._store(domain).list()

    def drop_profile(self, domain: str, key: str) -> dict:
        if not self._store(domain).delete(key):
            raise Refused(404, f"no single profile begins with {key!r}")
        return {"deleted": key}

    def page(self, result: dict | list | None = None) -> str:
        rows = result if isinstance(result, list) else [] if result is None else [result]
        cell = lambda x: escape(x if isinstance(x, str) else json.dumps(x, default=str))
        tables = "".join("<table>" + "".join(f"<tr><th>{cell(k)}<td>{cell(v)}" for k, v in r.items()) + "</table>" for r in rows)
        return PAGE.format(domains="".join(f"<option>{escape(x)}" for x in discover_domains(self.config_dir)), result=tables)


class Handler(BaseHTTPRequestHandler):
    service: Service

    def log_message(self, *args) -> None:
        """Requests aren't logged."""

    def _send(self, status: int, content: str, kind: str = "application/json") -> None:
        data = content.encode()
        self.send_response(status)
        self.send_header("Content-Type", f"{kind}; charset=utf-8")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _body(self) -> bytes:
        length = self.headers.get("Content-Length", "")
        if not length.isdigit() or int(length) > MOST_BYTES:
            raise Refused(413, "the request has no length, or is too long")
        return self.rfile.read(int(length))

    def _answer(self, method: str) -> None:
        url = urlsplit(self.path)
        query = {k: v[-1] for k, v in parse_qs(url.query).items()}
        path = unquote(url.path).removeprefix("/api/v1").strip("/").split("/")
        domain = query.get("domain", "trade")
        try:
            match method, path:
                case "GET", [""]:
                    return self._send(200, self.service.page(), "text/html")
                case "POST", [""]:
                    fields, uploads = read_form(self.headers.get("Content-Type", ""), self._body())
                    return self._send(200, self.service.page(self.service.jobs(fields.get("do", "analyze"), fields, uploads)), "text/html")
                case "GET", ["health"]:
                    out = {"status": "ok", "spark": self.service.spark.version}
                case "GET", ["domains"]:
                    out = discover_domains(self.service.config_dir)
                case "GET", ["profiles"]:
                    out = self.service.profiles(domain)
                case "DELETE", ["profiles", key]:
                    out = self.service.drop_profile(domain, key)
                case "POST", ["jobs", ("run" | "analyze" | "auto") as kind]:
                    out = self.service.jobs(kind, *read_form(self.headers.get("Content-Type", ""), self._body()))
                case _:
                    raise Refused(404, "no such page")
            self._send(200, json.dumps(out, default=str))
        except Refused as e:
            self._send(e.status, json.dumps({"detail": str(e)}))
        except Exception as e:  # noqa: BLE001  told to the one who asked; the service goes on
            self._send(500, json.dumps({"detail": f"{type(e).__name__}: {e}".splitlines()[0]}))

    def do_GET(self) -> None:
        self._answer("GET")

    def do_POST(self) -> None:
        self._answer("POST")

    def do_DELETE(self) -> None:
        self._answer("DELETE")


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"service": service}))
