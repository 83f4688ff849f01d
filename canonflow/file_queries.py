"""Driver queries that write the tables as files and read them by the engine's scans and jobs, with the SQL that says the same."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import DomainConfig, load_domain
from .job import JobResult, run_job
from .operators import dq, lineage
from .plans import mapping
from .queries import JOB, TOKENS, read
from .sources import archive, tables
from .sources.files import InputFile
from .staging import parts, put, shared_folder

DOMAINS = Path(__file__).parent.parent / "domains"
STAMP = "2024-01-01T00:00:00+00:00"


def trade() -> DomainConfig:
    return load_domain(DOMAINS, "trade")


def scanned(spark: SparkSession, paths: list[str], suffix: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The rows of files that are named as if they had a suffix, without their numbers. columns: those that a table has, though its files name only what they hold a value of."""
    found = [tables.scan(spark, InputFile(p, f"part{suffix}")).rows.drop(tables.INDEX) for p in paths]
    if columns:
        found.insert(0, spark.createDataFrame([], ", ".join(f"{c} string" for c in columns)))
    return dq.union_all(spark, found)


def _nations(spark: SparkSession, d: str) -> list[tuple]:
    """The 25 nations, a table of fixed size."""
    return [tuple(r) for r in read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").limit(25).collect()]


# scans


def s4_delimited_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pipe-delimited files, with quotes, delimiters and line breaks in a field."""
    note = F.concat(F.lit('a|"b"\n'), "o_orderpriority", F.lit("  c"))
    folder = shared_folder(spark, "delimited")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias(" Order Key "), F.col("o_orderstatus").alias("status"), note.alias("note"))
    rows.write.option("header", True).option("sep", "|").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return scanned(spark, parts(spark, folder), ".txt").withColumnRenamed("Order Key", "order_key")


def s6_json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of JSON objects; values keep their written form."""
    folder = shared_folder(spark, "json")
    read(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "props")).alias("value")).write.text(folder)
    return scanned(spark, parts(spark, folder), ".json", ("event_id", "event_type", "props"))


def s7_xml_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records of XML documents."""
    folder = shared_folder(spark, "xml")
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat("c_name", F.lit(" & <Söhne>")).alias("c_name"), "c_mktsegment")
    rows.write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(folder)
    return scanned(spark, parts(spark, folder), ".xml", ("c_custkey", "c_name", "c_mktsegment"))


def s14_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in files of each encoding."""
    folder = shared_folder(spark, "encoding")
    rows = [f"{a},{b} é" for a, b, _ in _nations(spark, d)]
    found = []
    for k, name in enumerate(("utf-8", "utf-8-sig", "utf-16", "cp1252")):
        path = put(spark, f"{folder}/{k}.csv", "\n".join(["key,näme", *rows[k::4]]).encode(name))
        parsed = tables.scan(spark, InputFile(path, f"{k}.csv"))
        found.append(parsed.rows.select("key", F.col("näme").alias("name"), F.lit(parsed.encoding).alias("encoding")))
    return dq.union_all(spark, found)


def _workbook(rows: list[tuple]) -> bytes:
    """An XLSX file of (number, text, date as a serial number)."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda x: f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>'
    lines = [f"<row>{text('key')}{text('name')}{text('since')}</row>", *[f'<row><c><v>{a}</v></c>{text(b)}<c s="1"><v>{c}</v></c></row>' for a, b, c in rows]]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return data.getvalue()


def s5_excel_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = [(a, b, 45_000 + c) for a, b, c in _nations(spark, d)]
    return scanned(spark, [put(spark, f"{shared_folder(spark, 'xlsx')}/n.xlsx", _workbook(rows))], ".xlsx")


def s8_html_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = "".join(f"<tr><td>{a}<td> {escape(b)} &amp;\n co</tr>" for a, b, _ in _nations(spark, d))
    page = f"<html><p>x</p><table><tr><th>key<th>name</tr>{rows}</table><table><tr><td>other</table>"
    return scanned(spark, [put(spark, f"{shared_folder(spark, 'html')}/n.html", page.encode())], ".html")


def s9_docx_scan(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{escape(str(x))}</w:t></w:r></w:p></w:tc>"
    lines = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b, *_ in [("key", "name"), *_nations(spark, d)])
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl>{lines}</w:tbl></w:body></w:document>')
    return scanned(spark, [put(spark, f"{shared_folder(spark, 'docx')}/n.docx", data.getvalue())], ".docx")


def s12_archive_lineage(spark: SparkSession, d: str) -> DataFrame:
    """A nested archive with entries that the guards refuse."""

    def zipped(entries: dict[str, bytes]) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, content in entries.items():
                z.writestr(name, content)
        return data.getvalue()

    table = "\n".join(["key,name", *[f"{a},{b}" for a, b, _ in _nations(spark, d)]]).encode()
    inner = zipped({"b.csv": table, "x.exe": b""})
    outer = zipped({"a.csv": table, "inner.zip": inner, "../c.csv": table, "d.rtf": b""})
    found = archive.Expander(spark, shared_folder(spark, "zip"), trade().section("ingestion"), JOB, STAMP).expand("outer.zip", outer)
    told = lineage.archive_lineage(spark, found.lineage).select(F.col("Archive_Entry_Name").alias("entry"), F.col("Parent_Archive").alias("parent"), F.col("Nested_Level").alias("level"), F.col("Extraction_Status").alias("status"))
    rows = dq.union_all(spark, [tables.scan(spark, f).rows.select(F.lit(f.name).alias("entry")) for f in found.files]).groupBy("entry").agg(F.count("*").alias("n_rows"))
    return told.join(F.broadcast(rows), "entry", "left")  # a row per file


def w1_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as the engine's CSV and read again."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat("c_name", F.lit(', "x"\ny')).alias("c_name"), "c_mktsegment")
    return scanned(spark, [sinks.write_csv(rows, f"{shared_folder(spark, 'csv')}/c.csv")], ".csv")


# mapping

SPREAD = ["Account Number", "Company Name", "Invoice No", "Invoice Date", "Currency", "Pay Date", "Billing Amount", "Client Code", "Account Ref", "Trans Date", "Remittance Amount", "Gross Value Payable", "Principal Entity Code", "Settlement Instruction CCY", "Value Snapshot Date"]


def m2_header_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A header of 15 columns mapped onto the trade domain, one of them by an override, with the propagated copy of the shared key."""
    header = spark.createDataFrame([("spread.csv", [*SPREAD, "Weird"])], "file string, header array<string>")
    found = mapping.map_headers(header, trade(), {"Weird": ("TRD_INVOICE", "Payment_Terms")})
    return found.select("file", "source", "canonical_table", "canonical_column", "match_method", "confidence", "propagated")


def m11_gate(spark: SparkSession, d: str) -> DataFrame:
    """Active tables, and mandatory columns that block, for headers that miss some columns, one for each order priority."""
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    full = F.array(*map(F.lit, ["account_number", "invoice_number", "invoice_date", "due_date", "invoice_amount", "payment_terms", "doe"]))
    headers = read(spark, d, "orders").select("o_orderpriority").distinct().select("o_orderpriority", F.slice(full, 1, priority + 2).alias("header"))
    gated = mapping.gate_headers(headers, trade())
    return gated.select("o_orderpriority", F.array_join("active", ",").alias("active"), F.array_join("blocked", ",").alias("blocked"))


def m13_mapping_exceptions(spark: SparkSession, d: str) -> DataFrame:
    config = trade()
    mappings = mapping.Mapper(config).all(SPREAD)
    rows = lineage.mapping_exceptions(mappings, mapping.blocked_columns(mappings, config), 80, "spread.csv")
    return spark.createDataFrame(rows, dq.EXCEPTION).select("Source_Column_Name", "Canonical_Table", "Canonical_Column", "Exception_Type")


def u3_column_lineage(spark: SparkSession, d: str) -> DataFrame:
    mappings = mapping.Mapper(trade()).all(SPREAD)
    found = lineage.column_lineage(spark, lineage.column_lineage_rows(mappings, JOB, "trade", "spread.csv", "MAP", None, STAMP))
    return found.select("Source_Filename", "Source_Column_Normalised", "Canonical_Column", "Match_Method", "Confidence_Score", "Was_Mandatory", "Met_Threshold", "Lookup_Variant_Matched")


def q11_exception_records(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions with ids that hash what they tell."""
    orders = read(spark, d, "orders").select(F.lit("orders").alias("Source_Filename"), F.col("o_orderkey").alias("Source_Row_Index"), F.col("o_orderpriority").alias("Priority"))
    faults = dq.cell_faults(orders, dq.Checks("ORDER", {"Priority": "string"}, ["Priority"], tokens=TOKENS))
    return lineage.exceptions_table(spark, [lineage.file_exception("bad.pdf", "UNSUPPORTED_FILE_TYPE", "no")], [faults], JOB, "trade", STAMP)


# jobs


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers without some, and orders as invoices with faults of every kind; some orders come twice."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    customers = read(spark, d, "customer").where("c_custkey % 10 <> 3")
    customers = customers.select(F.col("c_custkey").alias("account_number"), F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("country_code"), F.col("c_mktsegment").alias("town"))
    orders = read(spark, d, "orders")
    orders = orders.union(orders.where("o_orderkey % 71 = 0"))
    price: Column = F.floor("o_totalprice").cast("string")
    invoices = orders.select(
        F.col("o_custkey").alias("buyer_ref"),
        key.alias("inv_no"),
        F.date_format(day, "dd/MM/yyyy").alias("invoice_date"),
        F.date_add(day.cast("date"), (key % 40 - 5).cast("int")).cast("string").alias("due_date"),
        F.when(key % 97 == 0, "n/k").otherwise(F.concat(F.lit("$"), price)).alias("gross_amount"),
        F.lit("").alias("paid_date"),
        F.when(key % 13 == 0, (F.floor("o_totalprice") + 100).cast("string")).otherwise("--").alias("paid_amount"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "n/a").otherwise(F.col("o_orderpriority")).alias("terms"),
        F.lit("INV").alias("doc_type"),
        F.when(key % 50 == 0, "XXQ").when(key % 2 == 0, " usd").otherwise("EUR").alias("ccy"),
        F.date_format(day, "yyyy-MM-dd").alias("doe"),
    )
    return customers, invoices


def job_of(spark: SparkSession, d: str) -> JobResult:
    """The trade domain's job over the customers' and the orders' files; duplicates and integrity are checked over the whole job."""
    folder, inputs = shared_folder(spark, "job"), []
    for name, rows in zip(("customers", "invoices"), _sources(spark, d), strict=True):
        rows.coalesce(4).write.option("header", True).csv(f"{folder}/{name}")
        inputs += [InputFile(p, f"{name}_{k}.csv") for k, p in enumerate(parts(spark, f"{folder}/{name}"))]
    return run_job(spark, inputs, trade(), f"{folder}/out", scope="job", table_format="parquet")


def job_invoices(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    found = job_of(spark, d).tables["TRD_INVOICE"]
    return found.select("Account_Number", "Invoice_Number", day("Invoice_Date"), day("Due_Date"), "Invoice_Amount", "Paid_Amount", "Payment_Terms", "Currency", day("DOE"), "Record_Status", "Source_File_Format")


def job_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return job_of(spark, d).exceptions.groupBy("Exception_Type", "Canonical_Table", "Canonical_Column").agg(F.count("*").alias("n"))


def job_fill_report(spark: SparkSession, d: str) -> DataFrame:
    report = job_of(spark, d).quality["tables"]
    rows = [(t, c, x["total_rows"], x["null_count"], float(x["fill_rate"]), x["status"], x["mandatory"]) for t, entry in report.items() for c, x in entry["columns"].items()]
    return spark.createDataFrame(rows, "canonical_table string, column_name string, total_rows long, null_count long, fill_rate double, status string, mandatory boolean")


SUMMARY = ["Job_Status", "Total_Source_Rows", "Total_Canonical_Rows_Written", "Total_Exceptions", "Exceptions_Blocking", "Exceptions_DataQuality", "Exceptions_Informational", "Columns_Unmapped", "Mandatory_Columns_Blocked", "Job_Narrative"]


def a7_job_summary(spark: SparkSession, d: str) -> DataFrame:
    told = job_of(spark, d).summary
    return spark.createDataFrame([tuple(told[k] for k in SUMMARY)], ", ".join(f"{k} {'string' if k in ('Job_Status', 'Job_Narrative') else 'long'}" for k in SUMMARY))


_ALL = (s4_delimited_scan, s5_excel_scan, s6_json_scan, s7_xml_scan, s8_html_scan, s9_docx_scan, s12_archive_lineage, s14_encoding, w1_csv_round_trip, m2_header_mapping, m11_gate, m13_mapping_exceptions, u3_column_lineage, q11_exception_records, job_invoices, job_exceptions, job_fill_report, a7_job_summary)
QUERIES = {f.__name__: f for f in _ALL}

_SRC = """src AS (
    SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 97 = 0 AS odd FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 71 = 0)
)"""
_FAULTS = f"""{_SRC},
faults AS (
    SELECT 'MANDATORY_NULL' AS Exception_Type, 'Payment_Terms' AS Canonical_Column FROM src WHERE o_orderpriority = '4-NOT SPECIFIED'
    UNION ALL SELECT 'TYPE_MISMATCH', 'Invoice_Amount' FROM src WHERE odd
    UNION ALL SELECT 'DUPLICATE_KEY', NULL FROM orders WHERE o_orderkey % 71 = 0
    UNION ALL SELECT 'REFERENTIAL_INTEGRITY_FAIL', 'Account_Number' FROM src WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
    UNION ALL SELECT 'BUSINESS_RULE_FAIL', 'Due_Date' FROM src WHERE o_orderkey % 40 < 5
    UNION ALL SELECT 'BUSINESS_RULE_FAIL', 'Paid_Amount' FROM src WHERE o_orderkey % 13 = 0 AND NOT odd
    UNION ALL SELECT 'BUSINESS_RULE_FAIL', 'Currency' FROM src WHERE o_orderkey % 50 = 0
)"""
_FUZZY = [("Pay Date", "TRD_INVOICE", "Due_Date", 76), ("Billing Amount", "TRD_INVOICE", "Invoice_Amount", 74), ("Client Code", "TRD_CUSTOMER", "Account_Number", 72), ("Account Ref", "TRD_CUSTOMER", "Account_Number", 69), ("Trans Date", "TRD_INVOICE", "DOE", 67), ("Remittance Amount", "TRD_INVOICE", "Invoice_Amount", 64)]
_EXACT = [("Account Number", "TRD_CUSTOMER", "Account_Number"), ("Company Name", "TRD_CUSTOMER", "Company_Name"), ("Invoice No", "TRD_INVOICE", "Invoice_Number"), ("Invoice Date", "TRD_INVOICE", "Invoice_Date"), ("Currency", "TRD_INVOICE", "Currency")]
_MAPPED = [
    *[(s, f"'{t}'", c, "EXACT LOOKUP", 100, "false") for s, t, c in _EXACT],
    *[(s, f"'{t}'", c, "FUZZY MATCH", n, "false") for s, t, c, n in _FUZZY],
    *[(s, "NULL", "UNMAPPED", "NO MATCH", 0, "false") for s in SPREAD[11:]],
    ("Account Number", "'TRD_INVOICE'", "Account_Number", "EXACT LOOKUP", 100, "true"),
]
_NEAREST = {"Pay Date": "pay_by_date", "Billing Amount": "billed_amount", "Client Code": "client_no", "Account Ref": "account_no", "Trans Date": "data_date", "Remittance Amount": "invoice_amount"}
_FLAGS = {"Currency": False}
_NULLS = {"Invoice_Amount": "odd", "Paid_Date": "true", "Paid_Amount": "o_orderkey % 13 <> 0", "Payment_Terms": "o_orderpriority = '4-NOT SPECIFIED'"}
_RATE = "round((total_rows - null_count) * 100.0 / total_rows, 1)"


def _fill_sql() -> str:
    model = trade()
    invoice = " UNION ALL ".join(f"SELECT 'TRD_INVOICE' AS canonical_table, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER ({_NULLS.get(c, 'false')}) AS null_count, {c in model.mandatory('TRD_INVOICE')} AS mandatory FROM src" for c in model.columns("TRD_INVOICE"))
    there = ("Account_Number", "Company_Name", "Country_Code", "City")
    customer = " UNION ALL ".join(f"SELECT 'TRD_CUSTOMER', '{c}', count(*), count(*) FILTER ({c not in there}), {c in model.mandatory('TRD_CUSTOMER')} FROM customer WHERE c_custkey % 10 <> 3" for c in model.columns("TRD_CUSTOMER"))
    return f"WITH {_SRC} SELECT *, CAST({_RATE} AS DOUBLE) AS fill_rate, CASE WHEN {_RATE} >= 95 THEN 'PASS' WHEN {_RATE} >= 70 THEN 'WARN' ELSE 'FAIL' END AS status FROM ({invoice} UNION ALL {customer})"


def _values(rows: list[tuple]) -> str:
    shown = lambda x: x if isinstance(x, str) and x in ("NULL", "true", "false") else x if isinstance(x, str) and x.startswith("'") else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def _lineage_sql() -> str:
    names = {r[0]: r[0].lower().replace(" ", "_") for r in _MAPPED}
    mandatory = lambda c: str(c in ("Account_Number", "Company_Name", "Invoice_Number", "Invoice_Date", "Due_Date", "Invoice_Amount", "DOE")).lower()
    rows = []
    for s, t, c, method, n, copy in _MAPPED:
        must = mandatory(c) if t != "NULL" else "false"
        met = "false" if method == "NO MATCH" else "true" if copy == "true" or n >= 80 or must == "false" else "false"
        rows.append(("spread.csv", names[s], c, method, n, must, met, _NEAREST.get(s, names[s]) if method != "NO MATCH" else "NULL"))
    return f"SELECT * FROM (VALUES {_values(rows)}) t(Source_Filename, Source_Column_Normalised, Canonical_Column, Match_Method, Confidence_Score, Was_Mandatory, Met_Threshold, Lookup_Variant_Matched)"


_HASHED = "sha256(concat_ws(chr(1), 'JOB-1', Source_Filename, coalesce(CAST(Source_Row_Index AS VARCHAR), chr(2)), coalesce(Source_Column_Name, chr(2)), coalesce(Canonical_Table, chr(2)), coalesce(Canonical_Column, chr(2)), coalesce(Raw_Value, chr(2)), Exception_Type, Reason))"
_REQUIRED = ["Account_Number", "DOE", "Due_Date", "Invoice_Amount", "Invoice_Date", "Invoice_Number", "Payment_Terms"]
_GATED = {1: ("", ""), 2: ("TRD_INVOICE", ["DOE", "Due_Date", "Invoice_Amount", "Payment_Terms"])}
_COUNTED = "count(*) FILTER (Exception_Type {0})"
_PLURAL = "CAST({0} AS VARCHAR) || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END"


def _gate_sql() -> str:
    order = ["account_number", "invoice_number", "invoice_date", "due_date", "invoice_amount", "payment_terms", "doe"]
    columns = dict(zip(order, ["Account_Number", "Invoice_Number", "Invoice_Date", "Due_Date", "Invoice_Amount", "Payment_Terms", "DOE"], strict=True))
    rows = []
    for k in range(1, 6):
        there = {columns[x] for x in order[: k + 2]}
        rows.append((k, "TRD_INVOICE", ",".join(f"TRD_INVOICE.{c}" for c in _REQUIRED if c not in there)))
    return f"SELECT o_orderpriority, active, blocked FROM (SELECT DISTINCT o_orderpriority FROM orders) JOIN (VALUES {_values(rows)}) t(k, active, blocked) ON CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = k"


def _summary_sql() -> str:
    kinds = [("referential integrity failure", "= 'REFERENTIAL_INTEGRITY_FAIL'"), ("mandatory null", "= 'MANDATORY_NULL'"), ("duplicate key", "= 'DUPLICATE_KEY'"), ("other data quality exception", "IN ('TYPE_MISMATCH', 'BUSINESS_RULE_FAIL')")]
    said = " || ', ' || ".join(_PLURAL.format(_COUNTED.format(w), name) for name, w in kinds)
    rows = "(SELECT count(*) FROM src) + (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 3)"
    blocking = _COUNTED.format("= 'MANDATORY_NULL'")
    return f"WITH {_FAULTS} SELECT 'SUCCESS_WITH_EXCEPTIONS' AS Job_Status, {rows} AS Total_Source_Rows, {rows} AS Total_Canonical_Rows_Written, count(*) AS Total_Exceptions, {blocking} AS Exceptions_Blocking, count(*) - {blocking} AS Exceptions_DataQuality, CAST(0 AS BIGINT) AS Exceptions_Informational, CAST(0 AS BIGINT) AS Columns_Unmapped, CAST(0 AS BIGINT) AS Mandatory_Columns_Blocked, 'SUCCESS_WITH_EXCEPTIONS: ' || {said} || '.' AS Job_Narrative FROM faults"


ORACLE = {
    "s4_delimited_scan": "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status, 'a|\"b\"' || chr(10) || o_orderpriority || ' c' AS note FROM orders",
    "s5_excel_scan": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, strftime(DATE '2023-03-15' + n_regionkey, '%Y-%m-%d 00:00:00') AS since FROM nation",
    "s6_json_scan": "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events",
    "s7_xml_scan": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' & <Söhne>' AS c_name, c_mktsegment FROM customer",
    "s8_html_scan": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || ' & co' AS name FROM nation",
    "s9_docx_scan": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation",
    "s12_archive_lineage": "SELECT entry, parent, CAST(level AS INTEGER) AS level, status, CASE WHEN has THEN (SELECT count(*) FROM nation) END AS n_rows FROM (VALUES ('a.csv', 'outer.zip', 1, 'EXTRACTED', true), ('inner.zip', 'outer.zip', 1, 'EXTRACTED', false), ('b.csv', 'inner.zip', 2, 'EXTRACTED', true), ('x.exe', 'inner.zip', 2, 'BLOCKED_EXTENSION', false), ('../c.csv', 'outer.zip', 1, 'BLOCKED_ZIP_SLIP', false), ('d.rtf', 'outer.zip', 1, 'UNSUPPORTED', false)) t(entry, parent, level, status, has)",
    "s14_encoding": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || ' é' AS name, ['utf-8', 'utf-8-sig', 'utf-16', 'cp1252'][n_nationkey % 4 + 1] AS encoding FROM nation",
    "w1_csv_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"' || chr(10) || 'y' AS c_name, c_mktsegment FROM customer",
    "m2_header_mapping": f"SELECT 'spread.csv' AS file, * FROM (VALUES {_values([*_MAPPED, ('Weird', chr(39) + 'TRD_INVOICE' + chr(39), 'Payment_Terms', 'USER OVERRIDE', 100, 'false')])}) t(source, canonical_table, canonical_column, match_method, confidence, propagated)",
    "m11_gate": _gate_sql(),
    "m13_mapping_exceptions": f"SELECT * FROM (VALUES {_values([*[(s, t, c, 'LOW_CONFIDENCE_MAPPING') for s, t, c, _ in _FUZZY], ('NULL', 'TRD_INVOICE', 'Payment_Terms', 'UNMAPPED_MANDATORY')])}) t(Source_Column_Name, Canonical_Table, Canonical_Column, Exception_Type)",
    "u3_column_lineage": _lineage_sql(),
    "q11_exception_records": f"SELECT {_HASHED} AS Exception_ID, 'JOB-1' AS Job_ID, 'trade' AS Domain, *, '{STAMP}' AS Insert_Timestamp FROM (SELECT 'orders' AS Source_Filename, o_orderkey AS Source_Row_Index, 'Priority' AS Source_Column_Name, 'ORDER' AS Canonical_Table, 'Priority' AS Canonical_Column, o_orderpriority AS Raw_Value, 'MANDATORY_NULL' AS Exception_Type, 'Priority is mandatory and is null in this record' AS Reason FROM orders WHERE trim(o_orderpriority) IN ('', '4-NOT SPECIFIED') UNION ALL SELECT 'bad.pdf', NULL, NULL, NULL, NULL, NULL, 'UNSUPPORTED_FILE_TYPE', 'no')",
    "job_invoices": f"WITH {_SRC} SELECT CAST(o_custkey AS VARCHAR) AS Account_Number, CAST(o_orderkey AS VARCHAR) AS Invoice_Number, strftime(o_orderdate, '%Y-%m-%d') AS Invoice_Date, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER), '%Y-%m-%d') AS Due_Date, CASE WHEN NOT odd THEN CAST(price AS DOUBLE) END AS Invoice_Amount, CASE WHEN o_orderkey % 13 = 0 THEN CAST(price + 100 AS DOUBLE) END AS Paid_Amount, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a' ELSE o_orderpriority END AS Payment_Terms, CASE WHEN o_orderkey % 50 = 0 THEN 'XXQ' WHEN o_orderkey % 2 = 0 THEN 'usd' ELSE 'EUR' END AS Currency, strftime(o_orderdate, '%Y-%m-%d') AS DOE, 'ACTIVE' AS Record_Status, 'csv' AS Source_File_Format FROM src",
    "job_exceptions": f"WITH {_FAULTS} SELECT Exception_Type, 'TRD_INVOICE' AS Canonical_Table, Canonical_Column, count(*) AS n FROM faults GROUP BY ALL",
    "job_fill_report": _fill_sql(),
    "a7_job_summary": _summary_sql(),
}
