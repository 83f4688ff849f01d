"""Driver queries of the ingestion and data-quality engine, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DomainConfig
from .functions.text import clean_text, fingerprint, jaccard, nfkc, normalise_header_column, to_date, to_number
from .operators import dq, project, report
from .plans import mapping
from .sinks import listed

TOKENS = ["", "4-NOT SPECIFIED"]
JOB = "JOB-1"
ALIASES = [("economy", "PART", "Type"), ("standard", "PART", "Type"), ("promo", "PART", "Type"), ("customer_name", "CUSTOMER", "Name"), ("cust_name", "CUSTOMER", "Name"), ("order_date", "ORDER", "Date"), ("nation_1", "NATION", "Name"), ("nation_12", "NATION", "Name"), ("nation_20", "NATION", "Name"), ("nation", "NATION", "Name")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q1_mandatory_null(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.lit("orders").alias("Source_Filename"), F.col("o_orderkey").alias("Source_Row_Index"), F.col("o_orderpriority").alias("Priority"))
    found = dq.cell_faults(orders, dq.Checks("ORDER", {"Priority": "string"}, ["Priority"], tokens=TOKENS, sources={"Priority": "o_orderpriority"}))
    return found.select(F.col("Source_Row_Index").alias("orderkey"), F.col("Source_Column_Name").alias("source_column"), F.col("Canonical_Column").alias("canonical_column"), F.col("Raw_Value").alias("raw_value"), F.col("Exception_Type").alias("exception_type"), F.col("Reason").alias("reason"))


def _order_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.null_counts(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice"], TOKENS)


def q1_null_counts(spark: SparkSession, d: str) -> DataFrame:
    return _order_counts(spark, d)


def a1_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    return report.with_fill(_order_counts(spark, d))


def a3_merge_fill(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "orders").withColumn("file", F.col("o_orderstatus"))
    return report.merged_fill(report.null_counts(files, ["o_orderpriority", "o_totalprice"], TOKENS, ["file"]), ["column_name"])


def _amount() -> Column:
    """Prices as text: with currency signs and thousands, and some that are no numbers."""
    return F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/k")).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" € "), F.floor("o_totalprice").cast("string"))).otherwise(F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(",000")))


def q2_numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", _amount().alias("raw")).select("o_orderkey", "raw", to_number(F.col("raw"), TOKENS).alias("amount"))


def q2_type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.lit("orders").alias("Source_Filename"), F.col("o_orderkey").alias("Source_Row_Index"), _amount().alias("Amount"))
    found = dq.cell_faults(rows, dq.Checks("ORDER", {"Amount": "numeric"}, tokens=TOKENS))
    return found.select(F.col("Source_Row_Index").alias("orderkey"), F.col("Raw_Value").alias("raw_value"), F.col("Exception_Type").alias("exception_type"), F.col("Reason").alias("reason"))


def q3_date_coerce(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp_ntz")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "dd-MMM-yyyy")).otherwise(F.date_format(day, "yyyyMMdd"))
    return read(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", F.date_format(to_date(F.col("raw"), TOKENS), "yyyy-MM-dd").alias("day"))


def q4_duplicate_key(spark: SparkSession, d: str) -> DataFrame:
    extra = dq.duplicate_rows(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return extra.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("extra_rows"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")


def q5_referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Faults of lines whose order is absent, within a job of several files."""
    name = F.lit("x").alias("Source_Filename")
    lines = read(spark, d, "lineitem").select(name, F.col("l_orderkey").alias("Source_Row_Index"), F.col("l_orderkey").cast("string").alias("Order_Key"))
    parents = _parents(spark, d).select(name, F.col("o_orderkey").cast("string").alias("Key"))
    rule = {"from_table": "LINE", "from_column": "Order_Key", "to_table": "ORDER", "to_column": "Key"}
    found = dq.referential_integrity({"LINE": lines, "ORDER": parents}, rule, TOKENS, "job")
    return found.select(F.col("Source_Row_Index").alias("l_orderkey"), F.col("Raw_Value").alias("raw_value"), F.col("Exception_Type").alias("exception_type"), F.col("Reason").alias("reason"))


def _lines_apart(spark: SparkSession, d: str, orphans: bool) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return dq.orphans(lines, "l_orderkey", _parents(spark, d), "o_orderkey", TOKENS, orphans=orphans)


def q5_orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    return _lines_apart(spark, d, True)


def q5_valid_keys(spark: SparkSession, d: str) -> DataFrame:
    return _lines_apart(spark, d, False)


def _invoices(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders in the shape of invoices."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_discount").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    currency = F.when(F.col("l_linenumber") == 1, " usd").when(F.col("l_linenumber") == 2, "EUR").when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit("Q"), "l_linenumber"))
    return lines.select(
        F.lit("lines").alias("Source_Filename"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("Source_Row_Index"),
        F.col("l_shipdate").alias("Due_Date"),
        F.col("o_orderdate").alias("Invoice_Date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Paid_Amount"),
        F.col("o_totalprice").alias("Invoice_Amount"),
        currency.alias("Currency"),
    )


def _broken(spark: SparkSession, d: str, rule: str) -> DataFrame:
    found = dq.rule_faults(_invoices(spark, d), "TRD_INVOICE", [dq.RULES[rule]], TOKENS)
    return found.select(F.col("Source_Row_Index").alias("row_index"), F.col("Canonical_Column").alias("canonical_column"), F.col("Exception_Type").alias("exception_type"), F.regexp_extract("Reason", r"^\[(\w+)\]", 1).alias("rule_id"))


def q7_date_order_rule(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d, "INV_DUE_GE_INV_DATE")


def q8_amount_rule(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d, "PAID_LE_INVOICE")


def q9_code_set_rule(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d, "CURRENCY_ISO4217")


def q6_rule_registry(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        dq.declared_rule({"rule_id": "STATUS_KNOWN", "table": "ORDER", "predicate_sql": "upper(o_orderstatus) IN ('O', 'F')", "when_columns": ["o_orderstatus"], "message": "unknown status"}),
        dq.declared_rule({"rule_id": "PRICE_BOUND", "table": "ORDER", "predicate_sql": "o_totalprice <= 200000", "when_columns": ["o_totalprice"], "message": "too large"}),
        dq.declared_rule({"rule_id": "ABSENT", "table": "ORDER", "predicate_sql": "no_such_column > 0", "when_columns": ["no_such_column"]}),
    ]
    rows = read(spark, d, "orders").withColumn("Source_Filename", F.lit("orders")).withColumn("Source_Row_Index", F.col("o_orderkey"))
    found = dq.rule_faults(rows, "ORDER", rules, [""])
    return found.groupBy(F.regexp_extract("Reason", r"^\[(\w+)\]", 1).alias("rule_id")).agg(F.count("*").alias("violations"))


def exception_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: all kinds of check over orders and lineitem, counted by exception type."""
    count = lambda df, kind=None: df.groupBy(F.lit(kind).alias("Exception_Type") if kind else "Exception_Type").agg(F.count("*").alias("n"))
    orders = read(spark, d, "orders").select(F.lit("orders").alias("Source_Filename"), F.col("o_orderkey").alias("Source_Row_Index"), F.col("o_orderpriority").alias("Priority"), _amount().alias("Amount"), F.col("o_orderstatus").alias("Status"))
    cells = dq.cell_faults(orders, dq.Checks("ORDER", {"Priority": "string", "Amount": "numeric"}, ["Priority"], tokens=TOKENS))
    status = dq.declared_rule({"rule_id": "STATUS_KNOWN", "table": "ORDER", "predicate_sql": "upper(Status) IN ('O', 'F')", "when_columns": ["Status"]})
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    # duplicates are rows beyond a key's first, which sums tell as well as places do
    twice = lines.where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("DUPLICATE_KEY").alias("Exception_Type"), "n")
    dates = dq.rule_faults(_invoices(spark, d), "TRD_INVOICE", [dq.RULES["INV_DUE_GE_INV_DATE"]], TOKENS)
    # each part is counted where it is found; only counts meet
    parts = [count(cells), twice, count(_lines_apart(spark, d, True).select("l_orderkey"), "REFERENTIAL_INTEGRITY_FAIL"), count(dates), count(dq.rule_faults(orders, "ORDER", [status], TOKENS))]
    return dq.union_all(spark, parts).groupBy("Exception_Type").agg(F.sum("n").alias("n")).where("n > 0")


def a4_exception_tiers(spark: SparkSession, d: str) -> DataFrame:
    return report.tiers(exception_histogram(spark, d))


def p3_canonical_customer(spark: SparkSession, d: str) -> DataFrame:
    columns = {"c_custkey": [("CUSTOMER", "Account_Number", 100)], "c_name": [("CUSTOMER", "Company_Name", 100)], "c_mktsegment": [("CUSTOMER", "Segment", 91)]}
    source = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("c_name"), "c_mktsegment", F.col("c_custkey").alias("Source_Row_Index"))
    return project.project_table(source, "CUSTOMER", ["Account_Number", "Company_Name", "Segment", "City"], columns, project.Origin("customer", "parquet", JOB, "MAP-1", "C-1"), stamp=None)


def p3_canonical_invoice(spark: SparkSession, d: str) -> DataFrame:
    columns = {"o_orderkey": [("INVOICE", "Invoice_Number", 100)], "o_custkey": [("INVOICE", "Account_Number", 100)], "o_orderstatus": [("INVOICE", "Invoice_Type", 80)]}
    source = read(spark, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in columns], F.col("o_orderkey").alias("Source_Row_Index"))
    return project.project_table(source, "INVOICE", ["Account_Number", "Invoice_Number", "Invoice_Type", "Currency"], columns, project.Origin("orders", "parquet", JOB, "MAP-2", "C-1"), stamp=None)


def p1_normalise_header(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_type").alias("name"), normalise_header_column(F.concat(F.lit(" #"), "p_type", F.lit(".No- 1_ "))).alias("normal")).distinct()


def _config(**matching) -> DomainConfig:
    """A domain of the ALIASES."""
    model = {t: {"business_columns": {c: {"type": "string", "mandatory": t == "CUSTOMER"} for _, u, c in ALIASES if u == t} | ({"Key": {"type": "string", "mandatory": True}} if t == "CUSTOMER" else {})} for _, t, _ in ALIASES}
    return DomainConfig("names", {"matching": matching, "quality": {"mandatory_threshold": 80}}, model, {a: (t, c) for a, t, c in ALIASES})


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """Names of types and nations, mapped by their aliases alone."""
    names = read(spark, d, "part").select(F.col("p_type").alias("name")).union(read(spark, d, "nation").select("n_name")).distinct()
    return mapping.map_headers(names.select(F.array("name").alias("header")), _config(fuzzy_min_similarity=2))


def m2_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select(F.col("normalised").alias("name"), "canonical_table", F.when(F.col("canonical_table").isNotNull(), F.col("canonical_column")).alias("canonical_column"))


def p5_active_tables(spark: SparkSession, d: str) -> DataFrame:
    """Active tables and blocked columns of a header for each nation."""
    header = F.array(F.lit("Customer Name"), F.when(F.col("n_nationkey") % 2 == 0, "Cust-Name").otherwise("Other"), F.lit("nation"), F.col("n_name"))
    gated = mapping.gate_headers(read(spark, d, "nation").select("n_nationkey", header.alias("header")), _config(fuzzy_min_similarity=2))
    return gated.select("n_nationkey", F.array_join(F.array_sort("active"), ",").alias("active"), F.array_join("blocked", ",").alias("blocked"))


def m3_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar alias of each nation's name."""
    found = mapping.map_headers(read(spark, d, "nation").select(F.array("n_name").alias("header")), _config(exact_confidence=91))
    return found.where("canonical_table IS NOT NULL").select(F.col("normalised").alias("name"), F.col("variant").alias("alias"), "canonical_table", "canonical_column", "confidence")


def m8_alias_context(spark: SparkSession, d: str) -> DataFrame:
    """What a provider is told of the aliases, target by target."""
    lines = mapping.alias_context(_config().aliases).split("\n")
    return spark.createDataFrame([tuple(x.split(": ", 1)) for x in lines], "target string, names string")


def _header() -> Column:
    return F.array(F.lit(" Order Key"), F.concat("o_orderstatus", F.lit(" Col")), F.col("o_orderpriority"), F.lit("Total"))


def f1_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().select("o_orderstatus", "o_orderpriority", fingerprint(_header()).alias("fingerprint"))


def f3_jaccard(spark: SparkSession, d: str) -> DataFrame:
    saved = F.array(*map(F.lit, ["order key", "o col", "5-low", "total", "extra"]))
    names = F.transform(_header(), lambda x: F.lower(F.trim(x)))
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().select("o_orderstatus", "o_orderpriority", F.round(jaccard(names, saved), 3).alias("overlap"))


def u1_union_tables(spark: SparkSession, d: str) -> DataFrame:
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"), F.col("c_mktsegment").alias("segment"))
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("party_name"))
    return dq.union_all(spark, [customers, suppliers])


def u6_limit_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return listed(q1_mandatory_null(spark, d), ["orderkey", "raw_value"], 200)


def a6_mapping_method_counts(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).groupBy("match_method").agg(F.count("*").alias("n"))


def a5_narrative(spark: SparkSession, d: str) -> DataFrame:
    counts = {r.Exception_Type: r.n for r in exception_histogram(spark, d).collect()}  # a row per type
    return spark.createDataFrame([(report.narrative("SUCCESS_WITH_EXCEPTIONS", counts),)], "narrative string")


def s15_text_normalise(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("\u0001  "), "text", F.lit("  \t \u0007"))
    return read(spark, d, "documents").select("doc_id", clean_text(text).alias("cleaned")).select("doc_id", F.length("cleaned").cast("long").alias("n_chars_clean"), F.md5("cleaned").alias("digest"))


def s15_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(nfkc(F.col("text"))).alias("digest"))


def x_doc_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return dq.duplicate_rows(docs, ["text_sha"], ["doc_id"])


_ALL = (q1_mandatory_null, q1_null_counts, a1_fill_rate, a3_merge_fill, q2_numeric_coerce, q2_type_mismatch, q3_date_coerce, q4_duplicate_key, q5_referential_integrity, q5_orphan_rows, q5_valid_keys, q7_date_order_rule, q8_amount_rule, q9_code_set_rule, q6_rule_registry, a4_exception_tiers, p3_canonical_customer, p3_canonical_invoice, p1_normalise_header, p5_active_tables, m2_exact_lookup, m3_fuzzy_match, m8_alias_context, f1_fingerprint, f3_jaccard, u1_union_tables, u6_limit_exceptions, a6_mapping_method_counts, a5_narrative, s15_text_normalise, s15_nfkc, x_doc_duplicates)
QUERIES = {f.__name__: f for f in _ALL} | {"a2_exception_histogram": exception_histogram}

_NULL = "trim({c}) IN ('', '4-NOT SPECIFIED')"
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER ({_NULL.format(c=f'CAST({c} AS VARCHAR)')}) AS null_count FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_totalprice"))
_FILL = "round((total_rows - null_count) * 100.0 / total_rows, 1)"
_STATUS = "CASE WHEN {r} >= 95 THEN 'PASS' WHEN {r} >= 70 THEN 'WARN' ELSE 'FAIL' END"
_RAW = "CASE WHEN o_orderkey % 7 = 0 THEN 'n/k' WHEN o_orderkey % 5 = 0 THEN ' € ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',000' END"
_DAY = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE strftime(o_orderdate, '%Y%m%d') END"
_NORMAL = "trim(regexp_replace(regexp_replace(translate(lower(trim({c})), ' -.', '___'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"
_ALIAS = ", ".join(f"('{a}', '{t}', '{c}')" for a, t, c in ALIASES)
_MAPPED = f"SELECT name, canonical_table, canonical_column FROM (SELECT DISTINCT {_NORMAL.format(c='p_type')} AS name FROM part UNION SELECT {_NORMAL.format(c='n_name')} FROM nation) LEFT JOIN (VALUES {_ALIAS}) a(name, canonical_table, canonical_column) USING (name)"
_NULL_ROWS = f"SELECT o_orderkey AS orderkey, 'o_orderpriority' AS source_column, 'Priority' AS canonical_column, o_orderpriority AS raw_value, 'MANDATORY_NULL' AS exception_type, 'Priority is mandatory and is null in this record' AS reason FROM orders WHERE {_NULL.format(c='o_orderpriority')}"
_ANTI = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {n}EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')"
_JOINED = "SELECT l_orderkey * 8 + l_linenumber AS row_index, '{c}' AS canonical_column, 'BUSINESS_RULE_FAIL' AS exception_type, '{r}' AS rule_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {w}"
_LATE = _JOINED.format(c="Due_Date", r="INV_DUE_GE_INV_DATE", w="l_shipdate < o_orderdate")
_HIST = f"""SELECT Exception_Type, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT 'MANDATORY_NULL' AS Exception_Type, count(*) AS n FROM orders WHERE {_NULL.format(c='o_orderpriority')}
UNION ALL SELECT 'TYPE_MISMATCH', count(*) FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'DUPLICATE_KEY', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'REFERENTIAL_INTEGRITY_FAIL', count(*) FROM ({_ANTI.format(n='NOT ')})
UNION ALL SELECT 'BUSINESS_RULE_FAIL', count(*) FROM ({_LATE})
UNION ALL SELECT 'BUSINESS_RULE_FAIL', count(*) FROM orders WHERE upper(o_orderstatus) NOT IN ('O', 'F')) GROUP BY 1 HAVING sum(n) > 0"""
_TIER = "CASE WHEN Exception_Type = 'MANDATORY_NULL' THEN 'Blocking' ELSE 'DataQuality' END"
_LINEAGE = "'{f}' AS Source_Filename, CAST({k} AS BIGINT) AS Source_Row_Index, 'C-1' AS Source_Contributor_ID, 'parquet' AS Source_File_Format, '{m}' AS Mapping_Reference_ID, 'ACTIVE' AS Record_Status, 1 AS Record_Version, 'JOB-1' AS Inserted_By_Job, 'JOB-1' AS Last_Modified_By_Job, 'canonflow' AS Processing_System"
_NAMES = "[' order key', lower(o_orderstatus) || ' col', lower(o_orderpriority), 'total']"
_PAIRS = "(SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)"

ORACLE = {
    "q1_mandatory_null": _NULL_ROWS,
    "q1_null_counts": _COUNTS,
    "a1_fill_rate": f"SELECT *, CAST({_FILL} AS DOUBLE) AS fill_rate, {_STATUS.format(r=_FILL)} AS status FROM ({_COUNTS})",
    "a3_merge_fill": f"SELECT *, CAST({_FILL} AS DOUBLE) AS fill_rate, {_STATUS.format(r=_FILL)} AS status FROM ({_COUNTS}) WHERE column_name <> 'o_orderstatus'",
    "q2_numeric_coerce": f"SELECT o_orderkey, raw, TRY_CAST(regexp_replace(raw, '[$£€¥, ]', '', 'g') AS DOUBLE) AS amount FROM (SELECT o_orderkey, {_RAW} AS raw FROM orders)",
    "q2_type_mismatch": "SELECT o_orderkey AS orderkey, 'n/k' AS raw_value, 'TYPE_MISMATCH' AS exception_type, 'Amount expects numeric but got ''n/k''' AS reason FROM orders WHERE o_orderkey % 7 = 0",
    "q3_date_coerce": f"SELECT o_orderkey, raw, strftime(try_strptime(raw, ['%d/%m/%Y', '%d-%b-%Y', '%Y%m%d']), '%Y-%m-%d') AS day FROM (SELECT o_orderkey, {_DAY} AS raw FROM orders)",
    "q4_duplicate_key": "SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "q5_referential_integrity": f"SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS raw_value, 'REFERENTIAL_INTEGRITY_FAIL' AS exception_type, 'LINE.Order_Key=''' || l_orderkey || ''' has no matching ORDER.Key' AS reason FROM ({_ANTI.format(n='NOT ')})",
    "q5_orphan_rows": _ANTI.format(n="NOT "),
    "q5_valid_keys": _ANTI.format(n=""),
    "q7_date_order_rule": _LATE,
    "q8_amount_rule": _JOINED.format(c="Paid_Amount", r="PAID_LE_INVOICE", w="l_extendedprice * (1 - l_discount) > o_totalprice"),
    "q9_code_set_rule": _JOINED.format(c="Currency", r="CURRENCY_ISO4217", w="l_linenumber > 3"),
    "q6_rule_registry": "SELECT 'STATUS_KNOWN' AS rule_id, count(*) AS violations FROM orders WHERE upper(o_orderstatus) NOT IN ('O', 'F') HAVING count(*) > 0 UNION ALL SELECT 'PRICE_BOUND', count(*) FROM orders WHERE o_totalprice > 200000 HAVING count(*) > 0",
    "a2_exception_histogram": _HIST,
    "a4_exception_tiers": f"SELECT {_TIER} AS tier, CAST(sum(n) AS BIGINT) AS n FROM ({_HIST}) GROUP BY 1",
    "p3_canonical_customer": f"SELECT CAST(c_custkey AS VARCHAR) AS Account_Number, trim(c_name) AS Company_Name, trim(c_mktsegment) AS Segment, CAST(NULL AS VARCHAR) AS City, {_LINEAGE.format(f='customer', k='c_custkey', m='MAP-1')} FROM customer",
    "p3_canonical_invoice": f"SELECT CAST(o_custkey AS VARCHAR) AS Account_Number, CAST(o_orderkey AS VARCHAR) AS Invoice_Number, trim(o_orderstatus) AS Invoice_Type, CAST(NULL AS VARCHAR) AS Currency, {_LINEAGE.format(f='orders', k='o_orderkey', m='MAP-2')} FROM orders",
    "p1_normalise_header": f"SELECT DISTINCT p_type AS name, {_NORMAL.format(c=chr(39) + ' #' + chr(39) + ' || p_type || ' + chr(39) + '.No- 1_ ' + chr(39))} AS normal FROM part",
    "m2_exact_lookup": _MAPPED,
    "p5_active_tables": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'CUSTOMER' || CASE WHEN n_nationkey IN (1, 12, 20) THEN ',NATION' ELSE '' END WHEN n_nationkey IN (1, 12, 20) THEN 'NATION' ELSE '' END AS active, CASE WHEN n_nationkey % 2 = 0 THEN 'CUSTOMER.Key' ELSE '' END AS blocked FROM nation",
    "m8_alias_context": f"SELECT canonical_table || '.' || canonical_column AS target, string_agg(name, ', ' ORDER BY name) AS names FROM (VALUES {_ALIAS}) a(name, canonical_table, canonical_column) GROUP BY 1",
    "a5_narrative": f"SELECT 'SUCCESS_WITH_EXCEPTIONS: ' || string_agg(x, ', ' ORDER BY k) || '.' AS narrative FROM (SELECT k, CAST(sum(n) AS BIGINT) || ' ' || any_value(w) || CASE WHEN sum(n) = 1 THEN '' ELSE 's' END AS x FROM ({_HIST}) JOIN (VALUES ('REFERENTIAL_INTEGRITY_FAIL', 1, 'referential integrity failure'), ('MANDATORY_NULL', 2, 'mandatory null'), ('DUPLICATE_KEY', 3, 'duplicate key'), ('TYPE_MISMATCH', 4, 'other data quality exception'), ('BUSINESS_RULE_FAIL', 4, 'other data quality exception')) t(Exception_Type, k, w) USING (Exception_Type) GROUP BY k)",
    "f1_fingerprint": f"SELECT o_orderstatus, o_orderpriority, sha256(array_to_string(list_sort(list_transform({_NAMES}, lambda x: trim(x))), '|')) AS fingerprint FROM {_PAIRS}",
    "f3_jaccard": f"SELECT o_orderstatus, o_orderpriority, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 3) AS overlap FROM (SELECT *, list_transform({_NAMES}, lambda x: trim(x)) AS a, ['order key', 'o col', '5-low', 'total', 'extra'] AS b FROM {_PAIRS})",
    "u1_union_tables": "SELECT c_custkey AS party_key, c_name AS party_name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    "u6_limit_exceptions": f"SELECT * FROM ({_NULL_ROWS}) ORDER BY orderkey, raw_value LIMIT 200",
    "a6_mapping_method_counts": f"SELECT CASE WHEN canonical_table IS NULL THEN 'NO MATCH' ELSE 'EXACT LOOKUP' END AS match_method, count(*) AS n FROM ({_MAPPED}) GROUP BY 1",
    "s15_text_normalise": r"SELECT doc_id, CAST(length(cleaned) AS BIGINT) AS n_chars_clean, md5(cleaned) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(chr(1) || '  ' || text || '  ' || chr(9) || ' ' || chr(7), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), ' +', ' ', 'g') AS cleaned FROM documents)",
    "s15_nfkc": "",
    "x_doc_duplicates": "SELECT doc_id, text_sha FROM (SELECT doc_id, sha256(text) AS text_sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1",
}
del ORACLE["s15_nfkc"]
