"""Providers, spreadsheets, headers, the mapping of all fixtures, and the service."""

import datetime
import http.client
import io
import json
import re
import sys
import threading
import uuid
import zipfile
from pathlib import Path
from types import SimpleNamespace as Any

import pytest

from canonflow import config, file_queries, job, service
from canonflow.functions.text import DATE_FORMATS, FREE_FORMATS, date_shape
from canonflow.operators import report
from canonflow.plans import mapping, providers
from canonflow.sources import files, tables
from canonflow.sources.files import InputFile

ROOT = Path(__file__).parent.parent
DOMAINS = str(ROOT / "domains")


@pytest.fixture(scope="module")
def trade():
    return config.load_domain(DOMAINS, "trade")


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def table(section, columns):
    """Rows of a table of FIXTURES.md."""
    text = (ROOT / "FIXTURES.md").read_text("utf-8")
    part = text[text.index(section) :].split("\n## ")[0].split("\n### ")[0]
    rows = [[c.strip() for c in line.strip().strip("|").split(" | ")] for line in part.splitlines() if line.startswith("|")]
    return [r for r in rows if len(r) == columns and not set(r[0]) <= set("-: ") and r[0] != "File"]


def test_fixtures(trade):
    """Mapping counts, active tables and blocked columns of every header that the survey tells."""
    headers = {r[0].split(" (")[0]: re.findall(r"`([^`]+)`", r[-1]) for r in table("## 1. Source schemas", 4)}
    want = {r[0]: r[1:] for r in table("## 3. Mapping goldens", 8)}
    checked = 0
    for name, (_, columns, exact, fuzzy, none, active, blocked) in want.items():
        header = headers.get(name) or headers.get(name.split("/")[-1])
        if not header or len(header) != int(columns):
            continue
        checked += 1
        mapper = mapping.Mapper(trade)
        own = [mapper.one(h) for h in header]
        counts = [sum(x.method == m for x in own) for m in (mapping.EXACT, mapping.FUZZY, mapping.NO_MATCH)]
        assert counts == [int(exact), int(fuzzy), int(none)], name
        found = mapper.all(header)
        short = lambda t: t.removeprefix("TRD_")
        assert sorted(map(short, mapping.active_tables(found))) == ([] if active == "—" else sorted(active.split(", "))), name
        best = {}
        for x in found:
            best[x.table, x.column] = max(best.get((x.table, x.column), 0), x.confidence)
        told = [f"{short(t)}.{c} ({best.get((t, c), 0)})" for t, c in mapping.blocked_columns(found, trade)]
        assert told == ([] if blocked == "—" else sorted(blocked.split(", "))), name
    assert checked >= 20


def test_prompts(trade):
    asked = []
    reply = '{"canonical_table": "TRD_INVOICE", "canonical_column": "Due_Date", "confidence": 90}'
    own = config.DomainConfig("trade", trade.settings, trade.model, trade.aliases, 'For {domain}: "{source_col}"\n{lookup_context}\n{options_text}\n{{"confidence": 0}}')
    assert config.validate(own) == []
    m = mapping.Mapper(own, provider=lambda p: asked.append(p) or reply)
    assert m.one("zzzz qqq").column == "Due_Date" and asked[0].startswith('For trade: "zzzz qqq"') and "TRD_INVOICE.Currency" in asked[0]
    assert config.validate(config.DomainConfig("x", trade.settings, trade.model, {}, "{nothing}"))
    # a provider that fails leaves what is known without it
    slept = []
    m = mapping.Mapper(trade, provider=lambda p: (_ for _ in ()).throw(ConnectionError("down")), sleep=slept.append)
    assert m.one("zzzz qqq").method == mapping.NO_MATCH and m.one("Trans Date").method == mapping.FUZZY and slept == [1.0, 2.0] * 2
    assert [c for c, _ in m.failures] == ["zzzz qqq", "Trans Date"]


def test_providers(trade, monkeypatch):
    calls = {}

    def told(name, reply):
        return lambda **kw: calls.setdefault(name, kw) and reply

    monkeypatch.setitem(sys.modules, "anthropic", Any(Anthropic=lambda **kw: Any(messages=Any(create=told("Claude", Any(content=[Any(text="a"), Any(text="b")]))))))
    monkeypatch.setitem(sys.modules, "openai", Any(OpenAI=lambda **kw: Any(chat=Any(completions=Any(create=told("OpenAI", Any(choices=[Any(message=Any(content="ab"))])))))))
    genai = Any(Client=lambda **kw: Any(models=Any(generate_content=told("Gemini", Any(text="ab")))))
    monkeypatch.setitem(sys.modules, "google", Any(genai=genai))
    monkeypatch.setitem(sys.modules, "google.genai", genai)
    for name in providers.KNOWN:
        own = config.overlay(trade, provider=name)
        with pytest.raises(config.ConfigError, match="model"):
            providers.provider_of(config.DomainConfig("x", own.settings | {"llm": {"provider": name}}, own.model))
        own.settings["llm"]["model"] = {name: "m"}
        assert providers.provider_of(own)("hello") == "ab" and calls[name]["model"] == "m" and "hello" in str(calls[name])
    assert providers.provider_of(trade) is None
    monkeypatch.setitem(sys.modules, "openai", None)
    own = config.overlay(trade, provider="OpenAI")
    own.settings["llm"]["model"] = {"OpenAI": "m"}
    with pytest.raises(config.ConfigError, match="library"):
        providers.provider_of(own)


def test_aliases_are_lower_case(tmp_path):
    path = put(tmp_path, "x.csv", "source_variation,canonical_table,canonical_column\nInv No,T,C\n")
    assert config.load_aliases(path) == {"inv no": ("T", "C")}


def test_excel_dates(spark, tmp_path):
    assert [tables.excel_time(x, False) for x in ("45306", "45306.5", "0.25", "1", "59", "61", "x", "-1")] == ["2024-01-15 00:00:00", "2024-01-15 12:00:00", "06:00:00", "1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "x", "-1"]
    assert tables.excel_time("0.0", True) == "00:00:00" and tables.excel_time("1", True) == "1904-01-02 00:00:00"
    yes, no = ["yyyy-mm-dd", 'dd" of "mmm', "[h]:mm", "m/d/yy;@"], ["General", "0.00", '"days" 0', "[Red]0", "#,##0\\d", "_d0"]
    assert all(map(tables.is_date_format, yes)) and not any(map(tables.is_date_format, no))
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.xlsx", file_queries._workbook([(1, "a", 45306)])), "a.xlsx"))
    assert [tuple(r) for r in parsed.rows.collect()] == [("1", "a", "2024-01-15 00:00:00", 1)]


def test_all_sheets():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        for k in (1, 2):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>h</t></is></c></row><row><c><v>{k}</v></c></row></sheetData></worksheet>')
    assert tables.xlsx_rows(data.getvalue()) == [["h"], ["1"]] and tables.xlsx_rows(data.getvalue(), True) == [["h"], ["1"], ["2"]]


def test_names_that_differ_in_case(spark, tmp_path, trade):
    parsed = tables.scan(spark, InputFile(put(tmp_path, "a.csv", "ID,id,Id\n1,2,3\n"), "a.csv"))
    assert parsed.header == ["ID", "id", "Id"] and [tuple(r)[:3] for r in parsed.rows.collect()] == [("1", "2", "3")]
    path = put(tmp_path, "b.csv", "account_number,Company_Name,company_name,city\nA1,One,Two,X\n")
    out = job.run_job(spark, [path], trade, str(tmp_path / "out"))
    assert [r.Company_Name for r in out.tables["TRD_CUSTOMER"].collect()] == ["One"]
    assert [r.Source_Column_Name for r in out.column_lineage.collect()][:4] == ["account_number", "Company_Name", "company_name", "city"]


def test_wide_delimiters(spark, tmp_path):
    """Header and rows are normalised before they are cut."""
    for content, rows in (("a，b\n1，2\n＂x，y＂,3\n4,5,6\n", [("1", "2"), ("x,y", "3")]), ("a;b\n１；ﬁ\n7\n", [("1", "fi"), ("7", "")])):
        parsed = tables.scan(spark, InputFile(put(tmp_path, "w.csv", content), "w.csv"))
        assert parsed.header == ["a", "b"] and [tuple(r)[:2] for r in parsed.rows.orderBy(tables.INDEX).collect()] == rows
    assert parsed.dropped.collect() == []
    big = "a,b\n" + "1,2\n" * 300_000 + "3，4\n"
    parsed = tables.scan(spark, InputFile(put(tmp_path, "big.csv", big), "big.csv"))
    assert parsed.rows.where("a = '3' AND b = '4'").count() == 1 and parsed.rows.count() == 300_001
    assert files.column_names(["a", "A", "a_", "b"]) == ["a", "A_", "a__", "b"]


def test_date_shapes():
    """Texts that a format writes fit its shape."""
    java = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "M": "%m", "d": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "SSS": "123", "XXX": "+01:00", "MM": "%m", "dd": "%d"}
    for f in DATE_FORMATS + FREE_FORMATS:
        for day in (datetime.datetime(2024, 5, 3, 4, 5, 6), datetime.datetime(1999, 12, 31, 23, 59)):
            written = re.sub(r"'([^']*)'|([A-Za-z])\2*", lambda m: m[1] if m[1] is not None else day.strftime(java[m[0]]), f)
            assert re.match(date_shape(f), written), (f, written)
    assert date_shape("QQ yyyy") is None


def test_legacy_fill(spark):
    df = spark.createDataFrame([("f", 1.0, None), ("f", None, "")], "file string, n double, s string")
    counts = lambda **kw: {r.column_name: r.null_count for r in report.null_counts(df, ["n", "s"], [""], **kw).collect()}
    assert counts() == {"n": 1, "s": 2} and counts(filled=["n"]) == {"n": 0, "s": 2}


def test_job_leaves_no_staging(spark, tmp_path, trade):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("c.csv", "account_number,company_name\nA1,One\nA2,Two\n")
    out = job.run_job(spark, [put(tmp_path, "c.zip", data.getvalue())], trade, str(tmp_path / "out"))
    assert out.summary["Total_Source_Rows"] == 2 and out.tables["TRD_CUSTOMER"].count() == 2
    assert not list((tmp_path / "out").glob("*/_staging"))


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("service")
    own = service.server(service.Service(spark, DOMAINS, str(folder / "out"), str(folder / "profiles")), port=0)
    thread = threading.Thread(target=own.serve_forever, daemon=True)
    thread.start()
    yield own.server_address[1]
    own.shutdown()


def ask(port, method, path, fields=None, uploads=()):
    body, heads = None, {}
    if fields is not None:
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in fields.items()]
        parts += [f'--{mark}\r\nContent-Disposition: form-data; name="files"; filename="{n}"\r\nContent-Type: text/csv\r\n\r\n{c}\r\n' for n, c in uploads]
        body, heads = ("".join(parts) + f"--{mark}--\r\n").encode(), {"Content-Type": f"multipart/form-data; boundary={mark}"}
    connection = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
    connection.request(method, path, body, heads)
    answer = connection.getresponse()
    text = answer.read().decode()
    return answer.status, json.loads(text) if answer.headers["Content-Type"].startswith("application/json") else text


def test_service(served):
    upload = [("c.csv", "account_number,company_name,weird\nA1,One,X\nA2,,Y\n")]
    assert ask(served, "GET", "/api/v1/health")[1]["status"] == "ok" and ask(served, "GET", "/api/v1/domains") == (200, ["trade"])
    status, out = ask(served, "POST", "/api/v1/jobs/analyze", {"domain": "trade", "overrides": '{"weird": "TRD_CUSTOMER.City"}'}, upload)
    assert status == 200 and {x["Source_Column"]: x["Match_Method"] for x in out[0]["scorecard"]}["weird"] == mapping.OVERRIDE
    status, out = ask(served, "POST", "/api/v1/jobs/run", {"mandatory_threshold": "80", "fuzzy_min_similarity": "90"}, upload)
    assert status == 200 and out["Job_Status"] == "SUCCESS_WITH_EXCEPTIONS" and out["Total_Canonical_Rows_Written"] == 2 and re.fullmatch("[0-9a-f]{8}_c.csv", out["Source_Filename"])
    status, out = ask(served, "POST", "/api/v1/jobs/auto", {}, upload)
    assert status == 200 and [x["status"] for x in out["decisions"]] == ["REJECTED"] and out["job_summary"] is None
    status, page = ask(served, "POST", "/", {"do": "analyze"}, upload)
    assert status == 200 and "TRD_CUSTOMER.Company_Name" in page and "<form" in ask(served, "GET", "/")[1]
    assert ask(served, "GET", "/api/v1/profiles") == (200, [])
    for method, path, fields, want in (("DELETE", "/api/v1/profiles/abc", None, 404), ("GET", "/api/v1/none", None, 404), ("POST", "/api/v1/jobs/run", {}, 422), ("POST", "/api/v1/jobs/run", None, 413)):
        assert ask(served, method, path, fields)[0] == want or want == 413 and ask(served, method, path, fields)[0] == 415
    assert ask(served, "POST", "/api/v1/jobs/run", {"domain": "none"}, upload)[0] == 404
    assert ask(served, "POST", "/api/v1/jobs/run", {"overrides": "nonsense"}, upload)[0] == 422
    assert ask(served, "POST", "/api/v1/jobs/run", {"mandatory_threshold": "900"}, upload)[0] == 422


@pytest.mark.parametrize("name, table", [("s6_json_scan", "events"), ("s7_xml_scan", "customer")])
def test_scans_of_partitions_without_rows(spark, sf_dir, tmp_path, monkeypatch, name, table):
    """A large file of one row group is read by several tasks, of which the first may find no rows."""
    every = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    want = sorted(map(tuple, file_queries.QUERIES[name](spark, sf_dir).collect()))
    key = every.columns[0]
    for rows, result in ((every.collect(), want), ([], [])):
        df = spark.createDataFrame(spark.sparkContext.parallelize([], 1).union(spark.sparkContext.parallelize(rows, 1)), every.schema)
        monkeypatch.setattr(file_queries, "read", lambda *a, df=df: df)
        found = file_queries.QUERIES[name](spark, str(tmp_path))
        assert key in found.columns and sorted(map(tuple, found.collect())) == result
