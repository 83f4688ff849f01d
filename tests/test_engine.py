"""The engine's parts and whole jobs on small files made here."""

import io
import json
import math
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from canonflow import config, job
from canonflow.functions import text
from canonflow.operators import dq, project, report
from canonflow.plans import mapping, profiles
from canonflow.sources import archive, files, tables
from canonflow.sources.files import InputFile

ROOT = Path(__file__).parent.parent
DOMAINS = str(ROOT / "domains")
INVOICES = """account_number,invoice_number,invoice_date,due_date,invoice_amount,paid_date,paid_amount,payment_terms,invoice_type,currency,doe
A1,I1,2024-01-05,2024-02-05,"1,000.50",2024-02-01,1000.50,NET30,INV,USD,2024-03-01
A1,I2,2024-01-06,2024-02-06,200,,,NET30,INV,EUR,2024-03-01
"""


@pytest.fixture(scope="module")
def trade():
    return config.load_domain(DOMAINS, "trade")


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def run(spark, tmp_path, trade, *paths, **options):
    return job.run_job(spark, list(paths), trade, str(tmp_path / "out"), **options)


def kinds(result):
    return {r.Exception_Type: r.n for r in report.histogram(result.exceptions).collect()}


# configuration


def test_domains_and_validation(trade):
    assert config.discover_domains(DOMAINS) == ["trade"] and config.validate(trade) == []
    bad = lambda settings, model=None: config.validate(config.DomainConfig("x", settings, trade.model if model is None else model))
    good = {"matching": {}, "quality": {"mandatory_threshold": 80}}
    assert bad(good) == []
    assert bad({"quality": {"mandatory_threshold": 80}}) and bad({"matching": {}, "quality": 3})
    assert bad(good | {"quality": {}}) and bad(good | {"quality": {"mandatory_threshold": 101}}) and bad(good | {"quality": {"mandatory_threshold": "80"}})
    assert bad(good | {"llm": {"provider": "Oracle"}}) and bad(good, {"_metadata": {}}) and bad(good, {"T": {"x": 1}})
    assert config.overlay(trade, fuzzy_min_similarity=0.9).section("matching")["fuzzy_min_similarity"] == 0.9
    with pytest.raises(config.ConfigError):
        config.overlay(trade, mandatory_threshold=900)


# scalar functions


def test_numbers(spark):
    cases = {"$1,234.50": 1234.5, " 12 ": 12.0, "1.234,56": 1.23456, "1e5": 1e5, "1_000": 1000.0, "12d": None, "abc": None, "": None, None: None, "n/a": None, "-5": -5.0, ".5": 0.5, "５": None}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", text.to_number(F.col("x"), ["", "n/a"]).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_dates(spark):
    cases = {"2024-01-02": "2024-01-02", "01/02/2024": "2024-02-01", "12/25/2024": "2024-12-25", "3-4-2024": "2024-04-03", "2024/1/2": "2024-01-02", "02.01.2024": "2024-01-02", "20240102": "2024-01-02", "2 Jan 2024": "2024-01-02", "January 2 2024": "2024-01-02", "02-Jan-2024": "2024-01-02", "2024-13-40": None, "soon": None, "00/00/0000": None, "2024-01-02T10:11:12": "2024-01-02", "January 2, 2024": "2024-01-02"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", text.to_date(F.col("x"), ["00/00/0000"]).cast("date").cast("string").alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_headers(spark):
    names = ["  Invoice No. ", "Pay-By.Date", "__x__", "Straße #1", "A  B"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.normalise_header_column(F.col("n")).alias("y")).collect()
    assert {r.n: r.y for r in rows} == {n: text.normalise_header(n) for n in names}
    assert text.normalise_header("  Invoice No. ") == "invoice_no" and text.normalise_header("A-b", {"hyphens_to_underscore": False}) == "ab"


def test_nulls(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", " \t", " N/A ", "n/A", "0", " ")], "x string").select("x", text.is_null(F.col("x"), ["N/A"]).alias("y")).collect()
    assert [r.y for r in rows] == [True, True, True, True, False, False, True]


# mapping and profiles


def test_mapping_tiers(trade):
    m = mapping.Mapper(trade, {"Weird": ("TRD_INVOICE", "Currency")})
    assert (m.one("Weird").method, m.one("Weird").confidence) == (mapping.OVERRIDE, 100)
    assert (m.one("Invoice No").method, m.one("Invoice No").column) == (mapping.EXACT, "Invoice_Number")
    fuzzy = m.one("Invoce Date")
    assert (fuzzy.method, fuzzy.column, fuzzy.confidence) == (mapping.FUZZY, "Invoice_Date", int(22 / 23 * 100 * 0.91))
    assert m.one("zzzz qqq").method == mapping.NO_MATCH and not m.one("zzzz qqq").mapped
    found = m.all(["account_number", "invoice_number"])
    assert [(x.table, x.propagated) for x in found] == [("TRD_CUSTOMER", False), ("TRD_INVOICE", False), ("TRD_INVOICE", True)]
    assert mapping.active_tables(found) == []
    assert ("TRD_INVOICE", "Due_Date") in mapping.blocked_columns(m.all(["invoice_number", "invoice_date"]), trade)


# The reference's aliases in the order of its table.
ALIASES = [
    ("TRD_CUSTOMER", "Account_Number", "account_number account_no acct_no acct_number acct_num acc_no acc_num acc_number accountno accountnum buyer_account buyer_acct buyer_ref client_acct client_no client_number cust_no cust_num customer_no customer_number customer_ref debtor_no debtor_number debtor_ref ar_account ar_no acno"),
    ("TRD_CUSTOMER", "DUNS_Number", "duns_number duns duns_no duns_num dunsnumber duns_nbr"),
    ("TRD_CUSTOMER", "Government_ID", "government_id govt_id gov_id tax_id tax_number vat_id vat_number vat_no national_id ein taxpayer_id fiscal_id registration_number"),
    ("TRD_CUSTOMER", "Company_Name", "company_name company company_nm companyname business_name buyer_name org_name organization_name legal_name corp_name cust_name customer_name debtor_name trading_name entity_name firm_name name"),
    ("TRD_CUSTOMER", "Country_Code", "country_code country cntry_cd cntry iso_country country_iso ctry_code ctry"),
    ("TRD_CUSTOMER", "Address_1", "address_1 address1 addr1 addr_1 street street_address address_line_1 add1"),
    ("TRD_CUSTOMER", "Address_2", "address_2 address2 addr2 addr_2 street_2 address_line_2 add2"),
    ("TRD_CUSTOMER", "City", "city town city_nm suburb municipality"),
    ("TRD_CUSTOMER", "State", "state province region state_cd state_code county territory"),
    ("TRD_CUSTOMER", "Postcode", "postcode postal_code zip zip_code zipcode post_code postal_cd pin_code"),
    ("TRD_INVOICE", "Invoice_Number", "invoice_number invoice_no inv_no inv_num invno invoice_num invoice_ref inv_ref reference_number ref_no ref_num doc_number doc_no document_number bill_number bill_no invoice_id inv_id"),
    ("TRD_INVOICE", "Invoice_Date", "invoice_date inv_date invdate invoice_dt issue_date bill_date billing_date document_date doc_date date_of_invoice"),
    ("TRD_INVOICE", "Due_Date", "due_date duedate due_dt payment_due_date due_by maturity_date pay_by_date date_due"),
    ("TRD_INVOICE", "Invoice_Amount", "invoice_amount inv_amount inv_amt invoice_amt gross_amount total_amount original_amount billed_amount invoice_value inv_value orig_amount orig_amt"),
    ("TRD_INVOICE", "Paid_Date", "paid_date paiddate paid_dt payment_date date_paid settlement_date clearance_date"),
    ("TRD_INVOICE", "Paid_Amount", "paid_amount paid_amt paidamt payment_amount amount_paid pmt_amount pmt_amt amount_received receipt_amount"),
    ("TRD_INVOICE", "Payment_Terms", "payment_terms pay_terms pmt_terms terms credit_terms selling_terms terms_of_payment trade_terms"),
    ("TRD_INVOICE", "Invoice_Type", "invoice_type inv_type transaction_type record_type txn_type doc_type document_type"),
    ("TRD_INVOICE", "Currency", "currency currency_code curr_code ccy curr iso_currency"),
    ("TRD_INVOICE", "DOE", "doe date_of_experience reporting_date cutoff_date report_date exp_date data_date as_of_date submission_date batch_date"),
    ("TRD_INVOICE", "Account_Number", "invoice_account_number invoice_account_no inv_account_no bill_to_account buyer_invoice_account"),
]


def test_aliases(trade):
    want = {a: (t, c) for t, c, names in ALIASES for a in names.split()}
    assert len(want) == 206 and list(trade.aliases.items()) == list(want.items())
    m = mapping.Mapper(trade)
    for alias, target in want.items():
        for header in (alias, alias.replace("_", " ").title()):
            found = m.one(header)
            assert (found.table, found.column, found.method) == (*target, mapping.EXACT)


def test_provider(trade):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise ConnectionError
        return '```json\n{"canonical_table": "TRD_INVOICE", "canonical_column": "Due_Date", "confidence": 77, "reasoning": "r"}\n```'

    slept = []
    assert mapping.ask(flaky, "p", sleep=slept.append)["confidence"] == 77 and slept == [1.0]
    with pytest.raises(ValueError):
        mapping.ask(lambda p: "no json", "p", sleep=slept.append)
    with pytest.raises(ConnectionError):
        mapping.ask(lambda p: (_ for _ in ()).throw(ConnectionError()), "p", sleep=slept.append)
    assert slept == [1.0, 1.0, 2.0]
    assert mapping.Mapper(trade, provider=flaky).one("zzzz qqq").column == "Due_Date"
    assert mapping.Mapper(trade, provider=lambda p: '{"canonical_table": "TRD_INVOICE", "canonical_column": "Due_Date", "confidence": 10}').one("zzzz").method == mapping.NO_MATCH


def test_overrides():
    want = {"A b": ("T", "C")}
    assert mapping.parse_overrides("A b=T.C\n") == mapping.parse_overrides(["A b=T.C"]) == mapping.parse_overrides('{"A b": "T.C"}') == want
    assert mapping.parse_overrides(mapping.format_overrides(want)) == want
    for bad in ("A", "A=T", '{"A": "T"}'):
        with pytest.raises(ValueError):
            mapping.parse_overrides(bad)
    assert mapping.overrides_from_scorecard([{"Source_Column": "a", "Suggested_Target": "T.x", "Selected_Target": "T.y"}, {"Source_Column": "b", "Suggested_Target": "T.x", "Selected_Target": "T.x"}]) == {"a": ("T", "y")}


def test_profiles(tmp_path, spark):
    store = profiles.ProfileStore(tmp_path, "trade")
    rng = random.Random(5)
    for _ in range(20):
        names = [f"Col {rng.randrange(30)}" for _ in range(rng.randrange(1, 9))]
        other = rng.sample(names, len(names))
        assert profiles.header_fingerprint(names) == profiles.header_fingerprint([x.upper() for x in other])
        b = [f"col {rng.randrange(30)}" for _ in range(5)]
        assert profiles.overlap(names, b) == profiles.overlap(b, names)
    header = ["a", "B ", "c", "d"]
    key = store.save("first", header, {"a": "T.x"})
    assert spark.range(1).select(text.fingerprint(F.array(*map(F.lit, header)))).first()[0] == key
    assert store.match(["d", "C", "b", "A"]).kind == "EXACT" and store.match(["a", "b", "c", "d", "e"]).kind == "PARTIAL" and store.match(["x"]).kind == "NONE"
    store.used(key)
    store.save("again", header, {"b": "T.y"})
    assert store.load(key)["overrides"] == {"a": "T.x", "b": "T.y"} and store.list()[0]["use_count"] == 1
    assert not [p for p in (tmp_path / "trade").iterdir() if p.suffix != ".json"]
    assert store.delete(key[:8]) and store.match(header).kind == "NONE" and not store.delete(key)


# sources


def rows_of(parsed):
    return [tuple(r) for r in parsed.rows.orderBy(tables.INDEX).collect()]


@pytest.mark.parametrize("first, late, encoding", [("", "Müller €", "cp1252"), ("", "Müller €", "utf-8"), ("", "Müller\x81", "latin-1"), ("é", "Müller\x81", "latin-1"), ("é", "Müller €", "cp1252")])
def test_encoding_of_late_rows(spark, tmp_path, first, late, encoding):
    lines = ["name,b", f"x{first},first", *[f"plain,{k}" for k in range(120_000)], f"{late},last"]
    content = "\n".join(lines).encode(encoding)
    assert content[2000 : files.HEAD_BYTES].isascii() and len(content) > files.HEAD_BYTES + 100_000
    found = tables.scan(spark, InputFile(put(tmp_path, "late.csv", content), "late.csv"))
    assert found.encoding == encoding
    # the scan drops control characters
    assert found.rows.where("b IN ('first', 'last')").orderBy("Source_Row_Index").select("name").collect() == [(f"x{first}",), (late.replace("\x81", ""),)]


def test_delimited(spark, tmp_path):
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.txt", 'x|y |x\n1|"a|b\nc"|2\n3\n4|5|6|7\n8|9|ﬁ\n'), "a.txt"))
    assert (parsed.format, parsed.header) == ("pipe_delimited", ["x", "y", "x.1"])
    assert rows_of(parsed) == [("1", "a|b\nc", "2", 1), ("3", "", "", 2), ("8", "9", "fi", 3)]
    assert [r.raw for r in parsed.dropped.collect()] == ["4|5|6|7"]
    assert tables.scan(spark, InputFile(put(tmp_path, "b.tsv", "a\tb\n1\t2\n"), "b.tsv")).format == "tsv"
    latin = tables.scan(spark, InputFile(put(tmp_path, "c.csv", "näme,b\nMüller €,1\n".encode("cp1252")), "c.csv"))
    assert (latin.encoding, latin.header, rows_of(latin)) == ("cp1252", ["näme", "b"], [("Müller €", "1", 1)])
    wide = tables.scan(spark, InputFile(put(tmp_path, "d.csv", "a,b\n1,é\n".encode("utf-16")), "d.csv"))
    assert (wide.encoding, rows_of(wide)) == ("utf-16", [("1", "é", 1)])
    mark = tables.scan(spark, InputFile(put(tmp_path, "e.csv", b"\xef\xbb\xbfa;b\n1;2\n"), "e.csv"))
    assert (mark.header, mark.format, rows_of(mark)) == (["a", "b"], "semicolon_delimited", [("1", "2", 1)])
    with pytest.raises(ValueError):
        tables.scan(spark, InputFile(put(tmp_path, "f.csv", ""), "f.csv"))


def test_row_index(spark):
    df = project.with_row_index(spark.range(0, 100, 1, 7))
    assert [(r.id + 1) == r.Source_Row_Index for r in df.collect()] == [True] * 100


def test_rows_wider_than_the_header(spark, tmp_path):
    page = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>5</td></tr></table>"
    parsed = tables.scan(spark, InputFile(put(tmp_path, "w.html", page), "w.html"))
    assert parsed.header == ["a", "b", "Unnamed: 2", "Unnamed: 3"] and rows_of(parsed) == [("1", "2", "3", "4", 1), ("5", "", "", "", 2)]


def test_xls_by_its_library(monkeypatch):
    import sys
    from types import SimpleNamespace as Any

    cell = lambda value, ctype=1: Any(value=value, ctype=ctype)
    cells = [[cell("a"), cell("b")], [cell("", 0), cell("", 0)], [cell(3.0, 2), cell(1.5, 2)], [cell(1, 4), cell(42, 5), cell("x")]]
    sheet = Any(nrows=4, row=lambda k: cells[k])
    book = Any(XL_CELL_ERROR=5, XL_CELL_BOOLEAN=4, error_text_from_code={42: "#N/A"}, open_workbook=lambda file_contents: Any(sheet_by_index=lambda k: sheet))
    monkeypatch.setitem(sys.modules, "xlrd", book)
    assert tables.legacy_rows(b"x") == [["a", "b"], ["3", "1.5"], ["1", "#N/A", "x"]]


def test_other_formats(spark, tmp_path):
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.json", json.dumps([{"b": 12500.0, "a": "x"}, {"a": None}])), "a.json"))
    assert (parsed.header, rows_of(parsed)) == (["b", "a"], [("12500.0", "x", 1), (None, None, 2)])
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.xml", "<r><row><z>1</z><y>é</y></row><row><z>2</z></row></r>"), "a.xml"))
    assert (parsed.header, rows_of(parsed)) == (["z", "y"], [("1", "é", 1), ("2", None, 2)])
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.html", "<p>x</p><table><tr><th>a<th>b</tr><tr><td>1</td><td> 2 &amp; 3</td></tr></table><table><tr><td>9</td></tr></table>"), "a.html"))
    assert (parsed.header, rows_of(parsed)) == (["a", "b"], [("1", "2 & 3", 1)])
    with pytest.raises(ValueError):
        tables.scan(spark, InputFile(put(tmp_path, "b.html", "<p>none</p>"), "b.html"))
    spark.range(2).selectExpr("cast(id as string) a", "id b").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert rows_of(tables.scan(spark, InputFile(str(tmp_path / "p.parquet"), "p.parquet"))) == [("0", "0", 1), ("1", "1", 2)]
    for name in ("a.xls", "a.pdf", "a.rtf"):
        with pytest.raises(files.UnsupportedFile):
            tables.scan(spark, InputFile(put(tmp_path, name, "x"), name))


def zipped(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return data.getvalue()


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    doc = f"<w:document {w}><w:body><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell(1)}{cell(2)}</w:tr></w:tbl></w:body></w:document>"
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.docx", zipped({"word/document.xml": doc})), "a.docx"))
    assert (parsed.header, rows_of(parsed)) == (["a", "b"], [("1", "2", 1)])
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = {
        "xl/workbook.xml": f'<workbook {s} xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>5</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    }
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.xlsx", zipped(book)), "a.xlsx"))
    assert (parsed.header, rows_of(parsed)) == (["a", "", "bc"], [("5", "", "x", 1)])


def test_archive_guards(spark, tmp_path):
    expand = lambda data, **s: archive.Expander(spark, str(tmp_path / "x"), s, "J", "now").expand("root.zip", data)
    status = lambda e: [x[-2] for x in e.lineage]
    out = expand(zipped({"a.csv": "a,b\n1,2\n", "in.zip": zipped({"b.csv": "a\n"}), "c.rtf": "", "../d.csv": "", "e.exe": ""}), blocked_extensions=[".exe"])
    assert status(out) == ["EXTRACTED", "EXTRACTED", "EXTRACTED", "UNSUPPORTED", "BLOCKED_ZIP_SLIP", "BLOCKED_EXTENSION"]
    assert [(f.name, bool(f.archive_lineage_id)) for f in out.files] == [("a.csv", True), ("b.csv", True)] and out.lineage[2][3:5] == ("in.zip", "root.zip") and out.lineage[2][7] == 2
    assert status(expand(b"no zip")) == ["FAILED"]
    assert status(expand(zipped({"in.zip": zipped({"a.csv": ""})}), max_archive_nesting_depth=1)) == ["EXTRACTED", "BLOCKED_DEPTH"]
    assert status(expand(zipped({"in.zip": zipped({})}), enable_nested_archives=False)) == ["SKIPPED_NESTED"]
    assert status(expand(zipped({"a.csv": "", "b.csv": ""}), max_files_per_archive=1)) == ["EXTRACTED", "BLOCKED_COUNT_LIMIT"]
    assert status(expand(zipped({"a.csv": "x"}), max_single_extracted_file_mb=0)) == ["BLOCKED_SIZE"]
    assert status(expand(zipped({"a.csv": "x", "b.csv": ""}), max_uncompressed_size_mb=0)) == ["BLOCKED_TOTAL_SIZE"]
    locked = bytearray(zipped({"a.csv": "x"}))
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    assert status(expand(bytes(locked))) == ["BLOCKED_ENCRYPTED"]


# checks


def test_rules(spark):
    assert len(dq.CURRENCIES) == len(set(dq.CURRENCIES)) and {"USD", "EUR", "ZWL"} <= set(dq.CURRENCIES)
    rows = [("f", 1, "2024-01-01", "2024-01-02", 5.0, 4.0, "usd"), ("f", 2, "2024-01-03", "2024-01-02", 5.0, 6.0, "XXX"), ("f", 3, None, "2024-01-02", float("nan"), 6.0, None), ("f", 4, None, None, -99999.0, 0.0, "")]
    df = spark.createDataFrame(rows, "Source_Filename string, Source_Row_Index long, i string, d string, Invoice_Amount double, Paid_Amount double, Currency string").withColumns({"Invoice_Date": F.to_date("i"), "Due_Date": F.to_date("d")})
    rules = [dq.declared_rule({"rule_id": r}) for r in dq.RULES]
    found = dq.rule_faults(df, "TRD_INVOICE", rules, [""]).select("Source_Row_Index", "Canonical_Column").collect()
    assert sorted(map(tuple, found)) == [(2, "Currency"), (2, "Due_Date"), (2, "Paid_Amount"), (4, "Paid_Amount")]
    assert dq.declared_rule({"rule_id": "NO_SUCH"}) is None and dq.rule_faults(df.drop("Currency"), "TRD_INVOICE", rules[2:], [""]).count() == 0


def test_duplicates_and_nulls(spark):
    rows = [("f", k, x, y) for k, (x, y) in enumerate([("a", None), ("a", None), ("a", "1"), (None, None), (None, None)], 1)]
    df = spark.createDataFrame(rows, "Source_Filename string, Source_Row_Index long, x string, y string")
    found = dq.duplicate_keys(df, dq.Checks("T", {}, keys=["x", "y", "absent"])).orderBy("Source_Row_Index").collect()
    assert [r.Source_Row_Index for r in found] == [2, 5] and found[0].Raw_Value == "{'x': 'a', 'y': None}"


# whole jobs


def test_clean_job(spark, tmp_path, trade):
    out = run(spark, tmp_path, trade, put(tmp_path, "invoices.csv", INVOICES))
    assert out.summary["Job_Status"] == "SUCCESS" and out.summary["Total_Canonical_Rows_Written"] == 2 and list(out.tables) == ["TRD_INVOICE"]
    data = Path(out.outputs["TRD_INVOICE"]).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfAccount_Number,DOE,") and data.count(b"\n") == 3
    assert out.tables["TRD_INVOICE"].orderBy("Source_Row_Index").first().Invoice_Amount == 1000.5
    fill = out.quality["tables"]["TRD_INVOICE"]["columns"]
    assert (fill["Paid_Date"]["fill_rate"], fill["Paid_Date"]["status"], fill["DOE"]["status"]) == (50.0, "FAIL", "PASS")
    assert json.loads(Path(out.outputs["summary"]).read_text())["Job_Status"] == "SUCCESS" and out.column_lineage.count() == 12


def test_faulty_job(spark, tmp_path, trade):
    bad = INVOICES + "A1,I1,2024-01-05,2024-01-01,x,,,n/a,INV,ZZZ,2024-03-01\nA1,I9,2024-01-05,2024-02-05,1,2,3,4,5,6,7,8\n"
    out = run(spark, tmp_path, trade, put(tmp_path, "i.csv", bad))
    assert out.summary["Job_Status"] == "SUCCESS_WITH_EXCEPTIONS"
    assert kinds(out) == {"MANDATORY_NULL": 1, "TYPE_MISMATCH": 1, "DUPLICATE_KEY": 1, "BUSINESS_RULE_FAIL": 2, "PARSE_ERROR": 1}
    assert sum(kinds(out).values()) == out.summary["Total_Exceptions"] == out.summary["Exceptions_Blocking"] + out.summary["Exceptions_DataQuality"] + out.summary["Exceptions_Informational"]
    assert out.exceptions.select("Exception_ID").distinct().count() == out.exceptions.count()


def test_blocked_failed_and_batch(spark, tmp_path, trade):
    blocked = put(tmp_path, "b.csv", "invoice_number,invoice_date\nI1,2024-01-01\n")
    out = run(spark, tmp_path, trade, blocked)
    assert out.summary["Job_Status"] == "BLOCKED" and "TRD_INVOICE.Due_Date" in out.summary["Blocked_Mandatory_Details"] and kinds(out)["UNMAPPED_MANDATORY"] > 1
    out = run(spark, tmp_path, trade, put(tmp_path, "x.rtf", "x"), str(tmp_path / "absent.csv"))
    assert out.summary["Job_Status"] == "FAILED" and set(kinds(out)) == {"UNSUPPORTED_FILE_TYPE", "PARSE_ERROR"}
    assert job.run_job(spark, [blocked], "no_such", str(tmp_path), DOMAINS).summary["Job_Status"] == "FAILED"
    customers = "account_number,company_name,doe\nA1,One,x\nA2,Two,x\n"
    pack = put(tmp_path, "pack.zip", zipped({"c.csv": customers, "sub/i.csv": INVOICES, "bad.exe": ""}))
    out = run(spark, tmp_path, trade, pack, blocked)
    assert out.summary["Job_Status"] == "SUCCESS_WITH_EXCEPTIONS" and set(out.tables) == {"TRD_CUSTOMER", "TRD_INVOICE"} and "archive_lineage" in out.outputs
    assert out.column_lineage.where("Archive_Lineage_ID IS NOT NULL").count() > 0


def test_integrity_scopes(spark, tmp_path, trade):
    mixed = "account_number,company_name,invoice_number,invoice_date,due_date,invoice_amount,payment_terms,currency,doe\nA1,One,I1,2024-01-01,2024-02-01,5,NET,USD,2024-03-01\n"
    one, two = put(tmp_path, "m.csv", mixed), put(tmp_path, "i.csv", INVOICES.replace("A1,I2", "A7,I2"))
    assert "REFERENTIAL_INTEGRITY_FAIL" not in kinds(run(spark, tmp_path, trade, one, two))
    assert kinds(run(spark, tmp_path, trade, one, two, scope="job"))["REFERENTIAL_INTEGRITY_FAIL"] == 1


def test_analyze_and_auto(spark, tmp_path, trade):
    path, store = put(tmp_path, "i.csv", INVOICES), profiles.ProfileStore(tmp_path / "p", "trade")
    card = job.analyze(spark, [path], trade, store=store)[0]
    assert card["blocked"] == [] and card["profile"] == "NONE"
    out = job.run_auto(spark, [path], trade, store, str(tmp_path / "o"))
    assert out["job_summary"] is None and out["decisions"][0]["status"] == "REJECTED"
    store.save("invoices", INVOICES.splitlines()[0].split(","), mappings=card["scorecard"])
    pack = put(tmp_path, "p.zip", zipped({"i.csv": INVOICES, "other.csv": "a,b\n1,2\n"}))
    out = job.run_auto(spark, [path, pack, str(tmp_path / "absent.csv")], trade, store, str(tmp_path / "o"))
    assert [d["status"] for d in out["decisions"]] == ["ACCEPTED", "ACCEPTED", "REJECTED", "REJECTED"] and out["job_summary"]["Files_Processed"] == 2
    assert job.analyze(spark, [path], trade, store=store)[0]["profile"] == "EXACT"


def test_cli(spark, tmp_path, capsys):
    from canonflow import cli

    path = put(tmp_path, "i.csv", INVOICES)
    common = ["--config-dir", DOMAINS, "--profile-dir", str(tmp_path / "p")]
    assert cli.main(["run", path, "--output-dir", str(tmp_path / "o"), *common]) == 0
    assert cli.main(["auto", path, "--output-dir", str(tmp_path / "o"), *common]) == 1
    assert cli.main(["analyze", path, *common]) == 0 and cli.main(["profiles", "list", *common]) == 0
    assert '"Job_Status": "SUCCESS"' in capsys.readouterr().out


def test_streaming(spark, tmp_path, trade):
    from canonflow.streaming.ingest import ingest_folder

    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "i.csv", INVOICES)
    for _ in range(2):  # the second run finds nothing new
        ingest_folder(spark, str(tmp_path / "in"), trade, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_narrative_and_rounding():
    assert report.narrative("SUCCESS", {}) == "SUCCESS: no exceptions."
    assert report.narrative("X", {"MANDATORY_NULL": 2, "DUPLICATE_KEY": 1, "Y": 1}) == "X: 2 mandatory nulls, 1 duplicate key, 1 informational exception."
    assert math.isclose(round(12.25, 1), 12.2)
