"""Formats, encodings and small reads of input files."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Format of an extension.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".txt": "txt", ".xlsx": "xlsx", ".xls": "xls", ".json": "json", ".xml": "xml", ".html": "html", ".htm": "html", ".docx": "docx", ".pdf": "pdf", ".parquet": "parquet"}
DELIMITERS = [",", "\t", "|", ";"]
LABELS = {"|": "pipe_delimited", ";": "semicolon_delimited"}
HEAD_BYTES = 1 << 20


class UnsupportedFile(ValueError):
    pass


class EncodingProblem(ValueError):
    pass


@dataclass(frozen=True)
class InputFile:
    """A file to read: where it is, the name that rows carry, and the archive it came from."""

    path: str
    name: str
    archive_lineage_id: str | None = None


def extension(name: str) -> str:
    return PurePosixPath(name.replace("\\", "/")).suffix.lower()


def format_of(name: str) -> str | None:
    return FORMATS.get(extension(name))


def read_head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reaches."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def read_all(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def file_size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def detect_encoding(head: bytes, whole: bool = True) -> str:
    """utf-8-sig and utf-16 by their marks, else UTF-8 if it decodes, else cp1252, else latin-1."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for name in ("utf-8", "cp1252"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if name == "utf-8" and not whole and e.start >= len(head) - 3:  # a character that the cut splits
                return name
    return "latin-1"


def whole_encoding(spark: SparkSession, path: str, head: bytes) -> str:
    """The encoding of a file by all its bytes, of which `head` are the first. One pass, in parts, over a file that is longer than its head."""
    encoding = detect_encoding(head, len(head) < HEAD_BYTES)
    if len(head) < HEAD_BYTES or encoding not in ("utf-8", "cp1252"):
        return encoding
    # a line break is one byte in all of these, so a file is valid if its lines are
    line = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("b"))
    undefined = F.decode("b", "ISO-8859-1").rlike(r"[\x81\x8d\x8f\x90\x9d]")  # in cp1252
    utf8, latin = line.agg(F.min(F.is_valid_utf8(F.col("b").cast("string"))), F.max(undefined)).first()
    return "utf-8" if utf8 else "latin-1" if latin else "cp1252"


# Characters whose compatibility composition is a delimiter or a quote.
WIDE = "，﹐︐；﹔︔\u037e｜＂"


def has_wide(spark: SparkSession, path: str, head: bytes, encoding: str) -> bool:
    """Whether a file holds a character that becomes a delimiter or a quote when it is normalised."""
    if any(c in head.decode(encoding, "replace") for c in WIDE):
        return True
    if len(head) < HEAD_BYTES or encoding not in ("utf-8", "utf-8-sig"):
        return False
    return not spark.read.option("lineSep", "\n").text(path).where(F.col("value").rlike(f"[{WIDE}]")).isEmpty()


def sniff_delimiter(line: str) -> str:
    """The delimiter that the first line has most of; a comma if it has none."""
    best = max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))
    return best if line.count(best) else ","


def clean(text: str) -> str:
    """Compatibility composition, without control characters but tab and line breaks; runs of spaces are one."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if c in "\t\n\r" or unicodedata.category(c) != "Cc")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def column_names(header: list[str]) -> list[str]:
    """Names of columns for a header, that differ even if case doesn't count, as it does for the engine's names."""
    seen: set[str] = set()
    out = []
    for name in header:
        column = name
        while column.lower() in seen:
            column += "_"
        seen.add(column.lower())
        out.append(column)
    return out


def unique_names(names: list[str]) -> list[str]:
    """Header names, trimmed; a name that comes again gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out
