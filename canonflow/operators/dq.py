"""Data-quality checks as DataFrame expressions.

A canonical table has its business columns as strings and the lineage columns
Source_Filename and Source_Row_Index.  Cell checks are one projection: all
columns are checked in a scan, and the faults found are exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_null, strip, to_date, to_number

FAULT = "struct<Source_Column_Name:string,Canonical_Column:string,Raw_Value:string,Exception_Type:string,Reason:string>"
EXCEPTION = "Source_Filename string, Source_Row_Index long, Source_Column_Name string, Canonical_Table string, Canonical_Column string, Raw_Value string, Exception_Type string, Reason string"
FIELDS = [x.split()[0] for x in EXCEPTION.split(", ")]
# ISO 4217 codes.
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD "
    "HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN "
    "PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLL SOS SRD STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL"
).split()


@dataclass
class Checks:
    """What is checked in a table. types: canonical column to numeric, date or string; sources: canonical to source column."""

    table: str
    types: dict[str, str]
    mandatory: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=lambda: [""])
    strip_chars: list[str] | None = None
    sources: dict[str, str] = field(default_factory=dict)
    check_numbers: bool = True
    check_dates: bool = True


def fault(source: str | None, column: str | None, raw: Column, kind: str, reason: Column) -> Column:
    return F.struct(F.lit(source).cast("string").alias("Source_Column_Name"), F.lit(column).cast("string").alias("Canonical_Column"), raw.cast("string").alias("Raw_Value"), F.lit(kind).alias("Exception_Type"), reason.alias("Reason"))


def coerced(c: str, kind: str, checks: Checks) -> Column:
    if kind == "numeric" and checks.check_numbers:
        return to_number(F.col(c), checks.tokens, checks.strip_chars)
    if kind == "date" and checks.check_dates:
        return to_date(F.col(c), checks.tokens)
    return F.col(c)


def coerce(table: DataFrame, checks: Checks) -> DataFrame:
    """Numbers and dates in their types; what doesn't parse is null."""
    return table.withColumns({c: coerced(c, k, checks) for c, k in checks.types.items() if k in ("numeric", "date") and c in table.columns})


def cell_faults(table: DataFrame, checks: Checks) -> DataFrame:
    """MANDATORY_NULL and TYPE_MISMATCH rows (EXCEPTION), from one scan of the table before coercion."""
    faults = []
    for c, kind in checks.types.items():
        source, null = checks.sources.get(c, c), is_null(F.col(c), checks.tokens)
        if c in checks.mandatory:
            faults.append(F.when(null, fault(source, c, F.coalesce(F.col(c), F.lit("None")), "MANDATORY_NULL", F.lit(f"{c} is mandatory and is null in this record"))))
        if kind == "numeric" and checks.check_numbers or kind == "date" and checks.check_dates:
            reason = F.concat(F.lit(f"{c} expects {kind} but {'got' if kind == 'numeric' else 'could not parse'} '"), F.col(c), F.lit("'"))
            faults.append(F.when(~null & coerced(c, kind, checks).isNull(), fault(source, c, F.col(c), "TYPE_MISMATCH", reason)))
    if not faults:
        return table.sparkSession.createDataFrame([], EXCEPTION)
    found = F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")
    return located(table.select("Source_Filename", "Source_Row_Index", found).select("Source_Filename", "Source_Row_Index", "f.*"), checks.table)


def located(faults: DataFrame, table: str) -> DataFrame:
    return faults.withColumn("Canonical_Table", F.lit(table)).select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in EXCEPTION.split(", "))])


def duplicate_rows(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key that are not its first; nulls are equal. Rows of a key that comes once have no second to sort against."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("__place", place).where("__place > 1").drop("__place")


def duplicate_keys(table: DataFrame, checks: Checks, scope: str = "file") -> DataFrame:
    """DUPLICATE_KEY rows of a coerced table, within a file or (scope job) within the job."""
    keys = [k for k in checks.keys if k in table.columns]
    if not keys:
        return table.sparkSession.createDataFrame([], EXCEPTION)
    within = ["Source_Filename", *keys] if scope == "file" else keys
    text = lambda k: F.concat(F.lit(f"'{k}': "), F.coalesce(F.concat(F.lit("'"), F.col(k).cast("string"), F.lit("'")), F.lit("None")))
    shown = F.concat(F.lit("{"), F.concat_ws(", ", *[text(k) for k in keys]), F.lit("}"))
    found = duplicate_rows(table, within, ["Source_Filename", "Source_Row_Index"])
    found = found.select("Source_Filename", "Source_Row_Index", F.lit(None).cast("string").alias("Source_Column_Name"), F.lit(None).cast("string").alias("Canonical_Column"), shown.alias("Raw_Value"), F.lit("DUPLICATE_KEY").alias("Exception_Type"), F.concat(F.lit("Duplicate key "), shown, F.lit(f" in {checks.table}")).alias("Reason"))
    return located(found, checks.table)


def orphans(child: DataFrame, column: str, parent: DataFrame, to_column: str, tokens: list[str], within: list[str] | None = None, orphans: bool = True) -> DataFrame:
    """Rows of child whose value, if not null, no parent row has, or (orphans=False) some has. The join's side and strategy are left to the optimiser, which knows sizes."""
    within = within or []
    keys = parent.where(~is_null(F.col(to_column), tokens)).select(*within, strip(F.col(to_column)).alias("__key")).distinct()
    return child.where(~is_null(F.col(column), tokens)).withColumn("__key", strip(F.col(column))).join(keys, [*within, "__key"], "left_anti" if orphans else "left_semi").drop("__key")


def referential_integrity(tables: dict[str, DataFrame], rule: dict, tokens: list[str], scope: str = "file") -> DataFrame | None:
    """REFERENTIAL_INTEGRITY_FAIL rows; None if a table or column of the rule is absent."""
    child, column, parent, to_column = (rule[k] for k in ("from_table", "from_column", "to_table", "to_column"))
    if child not in tables or parent not in tables or column not in tables[child].columns or to_column not in tables[parent].columns:
        return None
    found = orphans(tables[child], column, tables[parent], to_column, tokens, ["Source_Filename"] if scope == "file" else [])
    reason = F.concat(F.lit(f"{child}.{column}='"), F.col(column).cast("string"), F.lit(f"' has no matching {parent}.{to_column}"))
    found = found.select("Source_Filename", "Source_Row_Index", F.lit(column).alias("Source_Column_Name"), F.lit(column).alias("Canonical_Column"), F.col(column).cast("string").alias("Raw_Value"), F.lit("REFERENTIAL_INTEGRITY_FAIL").alias("Exception_Type"), reason.alias("Reason"))
    if scope == "file":  # a file without parent rows isn't checked
        found = found.join(tables[parent].select("Source_Filename").distinct(), "Source_Filename", "left_semi")
    return located(found, child)


@dataclass(frozen=True)
class Rule:
    """A business rule: rows where `broken` holds fail, as far as the columns are there."""

    rule_id: str
    table: str
    columns: tuple[str, ...]
    broken: Callable[[], Column]
    reports: str
    message: Callable[[], Column]


def _said(rule_id: str, *parts: str | Column) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(f"[{rule_id}] "), *[F.coalesce(F.col(p[1:]).cast("string"), F.lit("null")) if p.startswith("$") else F.lit(p) for p in parts])


def _number(c: str) -> Column:
    """NaN is larger than all numbers here, and must not break a rule."""
    return F.when(~F.isnan(F.col(c)), F.col(c))


RULES: dict[str, Rule] = {
    r.rule_id: r
    for r in (
        Rule("INV_DUE_GE_INV_DATE", "TRD_INVOICE", ("Due_Date", "Invoice_Date"), lambda: F.col("Due_Date") < F.col("Invoice_Date"), "Due_Date", _said("INV_DUE_GE_INV_DATE", "Due_Date ", "$Due_Date", " is before Invoice_Date ", "$Invoice_Date")),
        Rule("PAID_LE_INVOICE", "TRD_INVOICE", ("Paid_Amount", "Invoice_Amount"), lambda: _number("Paid_Amount") > _number("Invoice_Amount"), "Paid_Amount", _said("PAID_LE_INVOICE", "Paid_Amount ", "$Paid_Amount", " exceeds Invoice_Amount ", "$Invoice_Amount")),
        Rule("CURRENCY_ISO4217", "TRD_INVOICE", ("Currency",), lambda: ~F.upper(strip(F.col("Currency"))).isin(CURRENCIES), "Currency", _said("CURRENCY_ISO4217", "'", "$Currency", "' is no ISO 4217 code")),
    )
}


def declared_rule(spec: dict) -> Rule | None:
    """The rule of a configuration entry: a registered one, or its own SQL (predicate_sql is what a good row fulfils, on when_columns)."""
    if spec.get("predicate_sql"):
        columns = tuple(spec["when_columns"])
        return Rule(spec["rule_id"], spec["table"], columns, lambda: ~F.expr(spec["predicate_sql"]), spec.get("exception_column", columns[0]), _said(spec["rule_id"], spec.get("message") or spec.get("description") or spec["predicate_sql"]))
    if known := RULES.get(spec.get("rule_id")):
        return Rule(known.rule_id, spec.get("table", known.table), known.columns, known.broken, known.reports, known.message)
    return None


def rule_faults(table: DataFrame, name: str, rules: Iterable[Rule], tokens: list[str]) -> DataFrame:
    """BUSINESS_RULE_FAIL rows of a coerced table, all rules in one scan. A rule with a null operand or an absent column isn't broken."""
    faults = []
    for r in rules:
        if r.table == name and all(c in table.columns for c in r.columns):
            there = reduce(lambda a, b: a & b, [~is_null(F.col(c).cast("string"), tokens) for c in r.columns])
            faults.append(F.when(there & r.broken(), fault(r.reports, r.reports, F.col(r.reports).cast("string"), "BUSINESS_RULE_FAIL", r.message())))
    if not faults:
        return table.sparkSession.createDataFrame([], EXCEPTION)
    found = F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")
    return located(table.select("Source_Filename", "Source_Row_Index", found).select("Source_Filename", "Source_Row_Index", "f.*"), name)


def union_all(spark: SparkSession, parts: list[DataFrame | None]) -> DataFrame:
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], EXCEPTION)


def run_checks(tables: dict[str, DataFrame], checks: dict[str, Checks], integrity: list[dict], rules: list[Rule], tokens: list[str], scope: str = "file", good: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(coerced tables, all exceptions). Lazy: nothing is computed here. good: the coerced tables, if they are at hand."""
    spark = next(iter(tables.values())).sparkSession
    good = good or {t: coerce(df, checks[t]) for t, df in tables.items()}
    found: list[DataFrame | None] = []
    for t, df in tables.items():
        found += [cell_faults(df, checks[t]), duplicate_keys(good[t], checks[t], scope)]
    found += [referential_integrity(good, r, tokens, scope) for r in integrity]
    found += [rule_faults(df, t, rules, tokens) for t, df in good.items()]
    return good, union_all(spark, found)
