"""Scans: each input file becomes a lazy table of strings with Source_Row_Index."""

from __future__ import annotations

import csv
import functools
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, nfkc
from ..operators.project import with_row_index
from . import files
from .files import EncodingProblem, InputFile, UnsupportedFile

SPARK_ENCODINGS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}
#: Spark has no cp1252: it is Latin-1 but for these characters.
C1 = [bytes([b]) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
INDEX = "Source_Row_Index"


@dataclass
class ParsedFile:
    """A source: header names, rows (strings, lazy), and the rows that its format dropped, if it can. names: the columns of rows, where they aren't the header's, since two of its names differ in case alone."""

    file: InputFile
    format: str
    header: list[str]
    rows: DataFrame
    encoding: str | None = None
    dropped: DataFrame | None = None
    names: list[str] | None = None

    def columns(self) -> dict[str, str]:
        """The column of rows for each header name."""
        return dict(zip(self.header, self.names or self.header, strict=True))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def indexed(rows: DataFrame) -> DataFrame:
    """Numbered by order; a file that one task reads needs no second pass."""
    if rows.rdd.getNumPartitions() == 1:
        return rows.withColumn(INDEX, F.monotonically_increasing_id() + 1)
    return with_row_index(rows, INDEX)


def normalised(rows: DataFrame, header: list[str], compose: bool) -> DataFrame:
    return rows.withColumns({h: clean_text(nfkc(F.col(quoted(h))) if compose else F.col(quoted(h))) for h in header})


def delimited_header(spark: SparkSession, file: InputFile) -> tuple[list[str], str, str]:
    """(header, delimiter, encoding): the first two from the head of a file, the encoding from all of it."""
    head = files.read_head(spark, file.path)
    encoding = files.whole_encoding(spark, file.path, head)
    text = files.clean(head.decode(encoding, "replace").lstrip("﻿"))
    lines = text.splitlines()
    if not lines or not lines[0].strip():
        raise ValueError("the file has no header")
    delimiter = files.sniff_delimiter(lines[0])
    return files.unique_names(next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))), delimiter, encoding


def parsed_rows(content: bytes, encoding: str, delimiter: str) -> list[list[str]]:
    """The records of a delimited file that is normalised as a whole before it is cut at its delimiters."""
    text = files.clean(content.decode(encoding, "replace").lstrip("\ufeff"))
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def scan_wide(spark: SparkSession, file: InputFile, header: list[str], delimiter: str, encoding: str) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped) of a delimited file with full-width delimiters or quotes, which is parsed within a task."""
    n, names = len(header), files.column_names(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = parsed_rows(content.as_py(), encoding, delimiter)[1:]
                good = [(r + [""] * (n - len(r)), None) if len(r) <= n else ([None] * n, delimiter.join(r)) for r in records]
                yield from string_batches([(*r, raw) for r, raw in good], [*names, "__raw"])

    schema = T.StructType([*[T.StructField(h, T.StringType()) for h in [*names, "__raw"]], T.StructField(INDEX, T.LongType())])
    every = spark.read.format("binaryFile").load(file.path).select("content").mapInArrow(run, schema)
    kept = every.where("__raw IS NULL").drop("__raw", INDEX).withColumn(INDEX, F.monotonically_increasing_id() + 1)
    return kept, every.where("__raw IS NOT NULL").select(F.col("__raw").alias("raw"))


def scan_delimited(spark: SparkSession, file: InputFile, kind: str, multi_line: bool = True, compose: bool = True) -> ParsedFile:
    """Short rows end in nulls; rows with more fields than the header are dropped, and told in `dropped`. multi_line=False lets Spark split large files whose fields hold no line breaks."""
    header, delimiter, encoding = delimited_header(spark, file)
    names, label = files.column_names(header), files.LABELS.get(delimiter, kind)
    if compose and files.has_wide(spark, file.path, files.read_head(spark, file.path), encoding):
        rows, dropped = scan_wide(spark, file, header, delimiter, encoding)
        return ParsedFile(file, label, header, rows, encoding, dropped, names)
    schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(header) + 1)])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", delimiter).option("encoding", SPARK_ENCODINGS[encoding]).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("maxCharsPerColumn", -1)
    rows = reader.csv(file.path)
    extra = f"_{len(header)}"
    value = lambda k: F.translate(f"_{k}", b"".join(C1).decode("latin-1"), b"".join(C1).decode("cp1252")) if encoding == "cp1252" else F.col(f"_{k}")
    named = indexed(rows.where(F.col(extra).isNull())).select(*[F.coalesce(value(k), F.lit("")).alias(h) for k, h in enumerate(names)], INDEX)
    dropped = rows.where(F.col(extra).isNotNull()).select(F.concat_ws(delimiter, *[f"_{k}" for k in range(len(header) + 1)]).alias("raw"))
    return ParsedFile(file, label, header, normalised(named, names, compose), encoding, dropped, names)


def first_keys(text: str) -> list[str]:
    """Keys of the first object of a JSON text that may be cut off, in their order."""
    start = text.find("{")
    if start < 0:
        raise ValueError("no JSON object")
    decoder, at, keys = json.JSONDecoder(), start + 1, []
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "}":
            return keys
        key, at = decoder.raw_decode(text, at)
        at = text.index(":", at) + 1
        while text[at] in " \t\r\n":
            at += 1
        _, at = decoder.raw_decode(text, at)
        keys.append(key)


def scan_json(spark: SparkSession, file: InputFile, kind: str = "json") -> ParsedFile:
    """Records; values keep their written form, missing ones are null. Lines of objects are split, an array is read in one task."""
    head = files.read_head(spark, file.path)
    text = head.decode(files.detect_encoding(head, len(head) < files.HEAD_BYTES), "replace").lstrip("﻿ \t\r\n")
    rows = spark.read.option("primitivesAsString", True).option("multiLine", text.startswith("[") or "\n" in text.split("}", 1)[0]).json(file.path)
    names = [c for c in rows.columns if c != "_corrupt_record"]
    if not names:
        raise ValueError("the file holds no JSON records")
    try:
        first = [k for k in first_keys(text) if k in names]
    except ValueError:
        first = []
    header = [*first, *[n for n in names if n not in first]]
    kinds = dict(rows.dtypes)
    rows = indexed(rows).select(*[(F.col(quoted(h)) if kinds[h] == "string" else F.to_json(quoted(h))).alias(h.strip()) for h in header], INDEX)
    return ParsedFile(file, kind, [h.strip() for h in header], rows, "utf-8")


def scan_xml(spark: SparkSession, file: InputFile, kind: str = "xml") -> ParsedFile:
    """The children of the root, as rows; columns in the order of the first one."""
    events = ET.iterparse(io.BytesIO(files.read_head(spark, file.path)), events=("start", "end"))
    tag, names, depth = None, [], 0
    try:
        for event, node in events:
            depth += 1 if event == "start" else -1
            if event == "start" and depth == 2 and tag is None:
                tag = node.tag
                names = [f"_{a}" for a in node.attrib]
            elif event == "start" and depth == 3:
                names.append(node.tag)
            elif event == "end" and depth == 1:
                break
    except ET.ParseError:
        if tag is None:
            raise
    if tag is None:
        raise ValueError("the document has no records")
    rows = spark.read.format("xml").option("rowTag", tag.split("}")[-1]).option("inferSchema", False).load(file.path)
    kinds = dict(rows.dtypes)
    plain = list(dict.fromkeys(n.split("}")[-1] for n in names))
    header = [n for n in plain if n in kinds] + [c for c in rows.columns if c not in plain]
    rows = indexed(rows).select(*[(F.col(quoted(h)) if kinds[h] == "string" else F.to_json(quoted(h))).alias(h.lstrip("_")) for h in header], INDEX)
    return ParsedFile(file, kind, [h.lstrip("_") for h in header], rows, "utf-8")


class _FirstTable(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and not self.done:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.end_cell()
                self.cell = []

    def end_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table") and self.depth == 1:
            self.end_cell()
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or not self.depth

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_rows(content: bytes) -> list[list[str]]:
    parser = _FirstTable()
    parser.feed(content.decode(files.detect_encoding(content), "replace"))
    parser.close()
    rows = [r for r in parser.rows if r]
    if not rows:
        raise ValueError("no tables found")
    return rows


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_rows(content: bytes) -> list[list[str]]:
    """Rows of all tables, the first one's first row being the header; without tables, paragraphs in a column `text`."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t")).strip()
    rows = [[text(c) for c in row.findall(f"{W}tc")] for table in root.iter(f"{W}tbl") for row in table.findall(f"{W}tr")]
    return rows or [["text"], *[[t] for p in root.iter(f"{W}p") if (t := text(p))]]


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


# Built-in number formats of dates and times.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def is_date_format(code: str) -> bool:
    """Whether a number format shows dates or times: it has a letter for one outside quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0].lower())
    return plain != "general" and bool(re.search("[ymdhs]", plain))


def excel_time(value: str, since_1904: bool) -> str:
    """A serial number as a date and time, as text; what is no number stays."""
    try:
        days = float(value)
    except ValueError:
        return value
    if not 0 <= days < 2_958_466:
        return value
    if days < 1:
        return str((datetime(1900, 1, 1) + timedelta(seconds=round(days * 86400))).time())
    # the 1900 system counts a day that never was, the 29th of February of that year
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if days < 60 else 30)
    return str(start + timedelta(seconds=round(days * 86400)))


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles of a workbook whose number format shows dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(f"{S}numFmt")}
    cells = root.find(f"{S}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (cells if cells is not None else [])]
    return {k for k, n in enumerate(ids) if (is_date_format(own[n]) if n in own else n in DATE_FORMAT_IDS)}


def xlsx_rows(content: bytes, all_sheets: bool = False) -> list[list[str]]:
    """Cells of the first sheet, as written; formulas by their stored values, dates as `2024-01-31 00:00:00`. all_sheets: further sheets follow, without their header rows where they equal the first one's."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        book, dates = ET.fromstring(z.read("xl/workbook.xml")), date_styles(z)
        since_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter(f"{S}workbookPr"))
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [ET.fromstring(z.read("xl/" + links[x.get(f"{R}id")].removeprefix("/xl/"))) for x in list(book.find(f"{S}sheets"))[: None if all_sheets else 1]]
    out: list[list[str]] = []
    for sheet in sheets:
        rows = []
        for row in sheet.iter(f"{S}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall(f"{S}c")):
                value, kind = c.findtext(f"{S}v") or "", c.get("t", "n")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif kind == "n" and value and int(c.get("s", 0)) in dates:
                    value = excel_time(value, since_1904)
                cells[column_number(c.get("r", "")) if c.get("r") else k] = value
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        rows = [r for r in rows if any(r)]
        out += rows[1:] if out and rows and rows[0] == out[0] else rows
    return out


def scanned_text(pages: list) -> str:
    """The text of pages that hold pictures of it. Needs pytesseract."""
    try:
        import pytesseract
    except ImportError as e:
        raise ValueError("the PDF has no readable text, and reading its pages as pictures needs pytesseract, which is not installed") from e
    return "\n".join(pytesseract.image_to_string(p.to_image(resolution=150).original) for p in pages)


def pdf_rows(content: bytes) -> list[list[str]]:
    """Text of a PDF, as comma-separated rows if it has several columns, else in a column `text`. Needs pdfplumber."""
    try:
        import pdfplumber
    except ImportError as e:
        raise UnsupportedFile("PDF files need pdfplumber, which is not installed") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        text = "\n".join(p.extract_text() or "" for p in pdf.pages)
        garbled = sum(not c.isprintable() and c != "\n" for c in text) / max(1, len(text))
        if len(text.strip()) < 20 or garbled > 0.15:
            text = scanned_text(pdf.pages)
    rows = list(csv.reader(io.StringIO(text)))
    return rows if rows and len(rows[0]) > 1 else [["text"], *[[x] for x in text.splitlines() if x.strip()]]


def legacy_rows(content: bytes) -> list[list[str]]:
    """Cells of the first sheet of an XLS workbook, as in xlsx_rows. Needs xlrd."""
    try:
        import xlrd
    except ImportError as e:
        raise UnsupportedFile("XLS files need xlrd, which is not installed; save the workbook as XLSX") from e

    def written(cell) -> str:
        if cell.ctype == xlrd.XL_CELL_ERROR:
            return xlrd.error_text_from_code.get(cell.value, "")
        if cell.ctype == xlrd.XL_CELL_BOOLEAN:
            return str(int(cell.value))
        if cell.ctype == getattr(xlrd, "XL_CELL_DATE", None):
            return excel_time(str(cell.value), book.datemode == 1)
        return str(int(cell.value)) if isinstance(cell.value, float) and cell.value.is_integer() else str(cell.value)

    book = xlrd.open_workbook(file_contents=content)
    sheet = book.sheet_by_index(0)
    rows = [[written(c) for c in sheet.row(k)] for k in range(sheet.nrows)]
    return [r for r in rows if any(r)]


BINARY: dict[str, Callable[[bytes], list[list[str]]]] = {"html": html_rows, "docx": docx_rows, "xlsx": xlsx_rows, "xls": legacy_rows, "pdf": pdf_rows}


def string_batches(rows: list, names: list[str], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of strings as batches, with their numbers."""
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        columns = [pa.array(c, pa.string()) for c in zip(*part, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(range(at + 1, at + 1 + len(part)), pa.int64())], names=[*names, INDEX])


def scan_binary(spark: SparkSession, file: InputFile, kind: str, all_sheets: bool = False) -> ParsedFile:
    """Documents, each parsed within a task; the driver parses one once for its header, which is as wide as the widest row: names that lack are `Unnamed: k`."""
    parse = functools.partial(xlsx_rows, all_sheets=all_sheets) if kind == "xlsx" else BINARY[kind]
    found = parse(read_whole(spark, file))
    width = max(map(len, found))
    header = files.unique_names([*found[0], *[f"Unnamed: {k}" for k in range(len(found[0]), width)]])
    names = files.column_names(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from string_batches([[*row, *[""] * (width - len(row))] for row in parse(content.as_py())[1:]], names)

    schema = T.StructType([*[T.StructField(h, T.StringType()) for h in names], T.StructField(INDEX, T.LongType())])
    rows = spark.read.format("binaryFile").load(file.path).select("content").mapInArrow(run, schema)
    return ParsedFile(file, "pdf_text" if kind == "pdf" else kind, header, rows, names=names)


def read_whole(spark: SparkSession, file: InputFile) -> bytes:
    return files.read_all(spark, file.path)


def scan_parquet(spark: SparkSession, file: InputFile, kind: str = "parquet") -> ParsedFile:
    rows = spark.read.parquet(file.path)
    header = rows.columns
    return ParsedFile(file, kind, header, indexed(rows).select(*[F.col(quoted(h)).cast("string").alias(h) for h in header], INDEX))


def scan(spark: SparkSession, file: InputFile, all_sheets: bool = False) -> ParsedFile:
    kind = files.format_of(file.name)
    if kind is None:
        raise UnsupportedFile(f"files of type {files.extension(file.name) or 'none'} are not supported")
    if kind in ("csv", "tsv", "txt"):
        return scan_delimited(spark, file, kind)
    if kind in BINARY:
        return scan_binary(spark, file, kind, all_sheets)
    return {"json": scan_json, "xml": scan_xml, "parquet": scan_parquet}[kind](spark, file, kind)


def header_of(spark: SparkSession, file: InputFile) -> list[str]:
    """Header names alone, from a file's head where its format allows."""
    kind = files.format_of(file.name)
    return delimited_header(spark, file)[0] if kind in ("csv", "tsv", "txt") else scan(spark, file).header


def error_type(e: Exception) -> str:
    if isinstance(e, UnsupportedFile):
        return "UNSUPPORTED_FILE_TYPE"
    return "ENCODING_ERROR" if isinstance(e, (EncodingProblem, UnicodeError)) else "PARSE_ERROR"
