"""WARC derivatives: metadata and conversion records linked to response records.

A response becomes a metadata record (all headers of the source, title, links)
and, if it holds text, a conversion record (the visible text of HTML, other
text as it is), each with WARC-Refers-To, the source's target URI and date, its
own block digest, and the source's payload digest.  Records can be written out
as the bytes of a WARC/1.1 file, and read again.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_tree import read_page

RESPONSE = "record_id string, target_uri string, date string, content binary"
RECORD = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content binary"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: A record's own WARC headers, in their order; an optional column of responses and of what is read.
WARC_HEADERS = "warc_headers array<struct<name:string,value:string>>"
Headers = list[tuple[str, str]]
#: What ends a block of headers, whichever line breaks it has.
BLANK_LINE = re.compile(rb"\r?\n\r?\n")
HTML_TYPES = frozenset(["text/html", "application/xhtml+xml"])
#: Types of text beside text/*, and those that end in +json or +xml.
TEXT_TYPES = frozenset("application/json application/xml application/javascript application/x-javascript application/ecmascript application/x-ndjson application/yaml application/sql application/x-sh".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def split_response(content: bytes) -> tuple[str, Headers, bytes]:
    """(status line, headers in their order, names in lower case, payload) of an HTTP response; a content without a status line is all payload."""
    if not content.startswith(b"HTTP/"):
        return "", [], content
    end = BLANK_LINE.search(content)
    head, payload = (content[: end.start()], content[end.end() :]) if end else (content.rstrip(b"\r\n"), b"")
    status, *lines = re.split(r"\r?\n", head.decode("latin-1"))
    headers: Headers = []
    for line in lines:
        key, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and headers:  # a folded header
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}".strip())
        elif colon:
            headers.append((key.strip().lower(), value.strip()))
    return status, headers, payload


def header(headers: Headers, name: str) -> str:
    """The last header of a name, or nothing."""
    return dict(headers).get(name, "")


def without_chunks(payload: bytes) -> bytes:
    """The body of a chunked payload; a payload that isn't chunked, whatever its headers say, stays as it is, and a cut one ends where it is cut."""
    out, at = [], 0
    while m := re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n").match(payload, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(payload[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if payload.startswith(b"\r\n", at) else payload.startswith(b"\n", at)
    return b"".join(out) if out and at >= len(payload) else payload


def unpacked(body: bytes, coding: str) -> bytes | None:
    """A body without its content coding; None for codings that can't be read here, and a cut or damaged one as far as it goes. A body that doesn't begin as the coding does was unpacked before."""
    if coding in ("", "identity"):
        return body
    if coding in ("gzip", "x-gzip"):
        if not body.startswith(b"\x1f\x8b"):
            return body
        forms = [31]
    elif coding == "deflate":
        forms = [15, -15]
    elif coding == "zstd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return None
    else:
        return None
    for form in forms:
        reader, out, at = zlib.decompressobj(form), [], 0
        try:
            for at in range(0, len(body), 1 << 16):
                out.append(reader.decompress(body[at : at + (1 << 16)]))
            return b"".join(out)
        except zlib.error:
            if any(out):
                return b"".join(out)
    return None


def read_as(body: bytes, charset: str) -> str | None:
    """A body in a charset of text, or None if Python knows none of that name that reads any bytes."""
    try:
        return body.decode(charset, "replace") if codecs.lookup(charset)._is_text_encoding else None
    except (LookupError, ValueError, TypeError, OverflowError, AssertionError):  # errors of Unicode are values' errors
        return None


def decode(body: bytes, headers: Headers) -> str:
    """By the byte-order mark, the charset of the last content type, that of a <meta> in the first KB, or as UTF-8; a charset that isn't known counts for nothing."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    told = re.findall(r"(?i)charset\s*=\s*[\"']?([\w.:+-]+)", header(headers, "content-type"))
    told += [x.decode() for x in re.findall(rb"(?i)<meta\s[^>]{0,500}?charset\s*=\s*[\"']?([\w.:+-]+)", body[:1024])]
    return next((x for name in told if (x := read_as(body, name)) is not None), None) or body.decode("utf-8", "replace")


def kind_of(headers: Headers, body: bytes) -> str:
    """html, text or other, by the content type; without one, HTML unless the first KB holds a zero byte."""
    kind = header(headers, "content-type").split(";")[0].strip().lower()
    if not kind or kind in HTML_TYPES or "/" not in kind:
        return "other" if b"\0" in body[:1024] and not body.startswith((b"\xff\xfe", b"\xfe\xff")) else "html"
    return "text" if kind.startswith("text/") or kind in TEXT_TYPES or kind.endswith(("+json", "+xml")) else "other"


def derivative_id(record_id: str | None, kind: str) -> str:
    """The same for the same source record, so that a task that runs again names its records alike."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{record_id}')}>"


def derive(record_id: str | None, uri: str | None, date: str | None, content: bytes | None, warc_headers: list[dict] | None = None, payload_digest: str | None = None) -> list[tuple]:
    """The metadata record of a response, and the conversion record (both RECORD) if it holds text. Its HTTP headers are fields source-<name>, its WARC headers source-warc-<name>."""
    status, headers, payload = split_response(content or b"")
    if "chunked" in header(headers, "transfer-encoding").lower():
        payload = without_chunks(payload)
    coded: bytes | None = payload
    for coding in reversed([x.strip().lower() for k, v in headers if k == "content-encoding" for x in v.split(",")]):
        coded = None if coded is None else unpacked(coded, coding)
    body, form, title, links = coded or b"", "other" if coded is None else kind_of(headers, coded), "", []
    text = None
    if form == "html":
        page = read_page(decode(body, headers))
        text, title, links = "\n".join(b.text for b in page.blocks).encode(), page.title, page.links
    elif form == "text":
        text = decode(body, headers).encode()
    source = payload_digest or digest(payload)
    own = [(f"source-{k}", v) for k, v in headers]
    own += [(f"source-warc-{x['name'].strip().lower().removeprefix('warc-')}", " ".join((x["value"] or "").split())) for x in warc_headers or [] if x and x["name"]]
    fields = [("source-payload-digest", source), ("source-length", str(len(payload))), ("title", title), ("text-digest", "" if text is None else digest(text)), *[("outlink", " ".join(x.split())) for x in links]]
    # of the source's headers, empty ones stay too
    told = [*[("source-status", status)][: bool(status)], *own, *[x for x in fields if x[1]]]
    about = "".join(f"{k}: {v}\r\n" for k, v in told).encode()
    blocks = [("metadata", "application/warc-fields", about)]
    if text is not None:
        blocks.append(("conversion", "text/plain; charset=utf-8", text))
    return [(derivative_id(record_id, kind), kind, record_id, uri, date, form, digest(block), source, block) for kind, form, block in blocks]


def build_derivatives(responses: DataFrame) -> DataFrame:
    """A metadata row of RECORD for each row of `responses` (RESPONSE, and WARC_HEADERS and payload_digest if it has them; other columns are not read), and a conversion row if it holds text.

    Chunks and content codings (gzip, deflate, zstd) are undone before; images and other types without text, and codings that
    can't be read, have metadata alone. A payload digest that the source states is kept; else it is the SHA-1 of the payload
    without chunks. A null content is an empty one, and has an empty conversion. Null ids, URIs and dates stay null; repeated
    rows give repeated records, with the same identifiers. An empty table gives an empty result.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.binary() if x.endswith("binary") else pa.string() for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += (new := derive(*row))
                held += sum(len(x[-1]) for x in new)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    wanted = [responses[x.split()[0]].cast(x.split()[1]).alias(x.split()[0]) for x in RESPONSE.split(", ")]
    wanted += [(responses[name].cast(form) if name in responses.columns else F.lit(None).cast(form)).alias(name) for name, form in (WARC_HEADERS.split(), ("payload_digest", "string"))]
    return responses.select(*wanted).mapInArrow(run, RECORD)


def record_bytes(row, compress: bool = True) -> bytes:
    """A record as it stands in a WARC file, one gzip member if compressed. One that refers to another tells that one's URI and date, too."""
    heads = [
        ("WARC-Type", row["type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", row["refers_to"] and row["target_uri"]),
        ("WARC-Refers-To-Date", row["refers_to"] and row["date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Block-Digest", row["block_digest"]),
        ("WARC-Payload-Digest", row["payload_digest"]),
        ("Content-Type", row["content_type"]),
        ("Content-Length", str(len(row["content"]))),
    ]
    data = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads if v is not None) + "\r\n").encode() + bytes(row["content"]) + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def parse_records(data: bytes) -> Iterator[dict]:
    """The records (RECORD and WARC_HEADERS) of a WARC file's bytes, gzip members or plain, one after the other; no more than one is unpacked at a time.

    A record whose length is no number is left out, and reading goes on at the next one; a file that is cut or damaged ends with
    the last record that is whole.
    """
    source = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        source = gzip.GzipFile(fileobj=source)
    try:
        yield from _records(source)
    except (EOFError, OSError, zlib.error):
        return


def _records(source) -> Iterator[dict]:
    while line := source.readline():
        if not line.startswith(b"WARC/1."):
            continue
        every: list[dict[str, str]] = []
        while (line := source.readline()).strip():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and every:  # a folded header
                every[-1]["value"] += " " + text.strip()
                continue
            key, _, value = text.partition(":")
            every.append({"name": key.strip(), "value": value.strip()})
        heads = {x["name"].lower(): x["value"] for x in every}
        length = heads.get("content-length") or "0"
        if not re.fullmatch("[0-9]{1,18}", length):
            continue
        content = source.read(int(length))
        if len(content) < int(length):
            return
        told = {k: heads.get(f"warc-{n}") for k, n in (("record_id", "record-id"), ("type", "type"), ("refers_to", "refers-to"), ("target_uri", "target-uri"), ("date", "date"), ("block_digest", "block-digest"), ("payload_digest", "payload-digest"))}
        yield told | {"content_type": heads.get("content-type"), "content": content, "warc_headers": every}


def read_warc(spark: SparkSession, path: str, warc_headers: bool = False) -> DataFrame:
    """Rows of RECORD, and WARC_HEADERS if asked for, of the WARC files at a path; a file is read within one task, which holds its packed bytes and one record."""

    schema = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.string()) for x in RECORD.split(", ")])
    if warc_headers:
        schema = schema.append(pa.field("warc_headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse_records(content.as_py()):
                    rows.append(record)
                    held += len(record["content"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"{RECORD}, {WARC_HEADERS}" if warc_headers else RECORD)
