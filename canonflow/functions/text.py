"""Column expressions on strings: nulls, numbers, dates, headers, normal forms."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that numbers may carry.
NUMERIC_STRIP = ["$", "£", "€", "¥", ",", " "]
# Date formats in the order in which they are tried, day before month.
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "yyyy/M/d", "d.M.yyyy", "M.d.yyyy", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d-MMM-yyyy", "d-MMMM-yyyy"]
#: Tried after these, for what a free-form parser takes.
FREE_FORMATS = ["yyyy-M-d HH:mm:ss", "yyyy-M-d'T'HH:mm:ss", "yyyy-M-d'T'HH:mm:ss.SSS", "yyyy-M-d'T'HH:mm:ssXXX", "yyyy-M-d HH:mm", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "yyyy-M", "yyyy"]
#: What each part of a date format looks like.
DATE_PARTS = {"yyyy": "[0-9]{4}", "MMMM": "(?:[A-Za-z]{4,9}|[Mm][Aa][Yy])", "MMM": "[A-Za-z]{3}", "MM": "(?:0[1-9]|1[0-2])", "M": "(?:0?[1-9]|1[0-2])", "dd": "(?:0[1-9]|[12][0-9]|3[01])", "d": "(?:0?[1-9]|[12][0-9]|3[01])", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "SSS": "[0-9]{3}", "XXX": "(?:Z|[+-][0-9]{2}:[0-9]{2})"}
PYTHON_FLOAT = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
HEADER_STEPS = {"lowercase": True, "spaces_to_underscore": True, "hyphens_to_underscore": True, "dots_to_underscore": True, "strip_special_chars": True, "collapse_underscores": True, "strip_leading_trailing_underscores": True}


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def is_null(c: Column, tokens: list[str]) -> Column:
    """Null, blank, or one of the tokens after trimming; never null itself."""
    return c.isNull() | F.coalesce(strip(c).isin([*tokens, ""]), F.lit(True))


def to_number(c: Column, tokens: list[str], strip_chars: list[str] | None = None) -> Column:
    """Double, or null for nulls and for what is no number."""
    chars = "".join(NUMERIC_STRIP if strip_chars is None else strip_chars)
    plain = F.translate(strip(c), chars, "")
    number = F.when(plain.rlike(PYTHON_FLOAT), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(~is_null(c, tokens), number)


def date_shape(date_format: str) -> str | None:
    """A pattern that the texts of a date format fit; None for formats with other parts than DATE_PARTS."""
    out = ""
    for m in re.finditer(r"'([^']*)'|([A-Za-z])\2*|.", date_format):
        if m[2] and m[0] not in DATE_PARTS:
            return None
        out += re.escape(m[1]) if m[1] is not None else DATE_PARTS[m[0]] if m[2] else re.escape(m[0])
    return f"^{out}$"


def to_date(c: Column, tokens: list[str], formats: list[str] | None = None) -> Column:
    """Timestamp without time zone, of the first format that fits; null for nulls and for what is no date.

    A text's shape tells the format, since a parser's failures are costly. Of two formats of one shape and order of digits, only
    the first can fit: a day that a month doesn't have is no month either.
    """
    plain, tries = strip(c), (formats or DATE_FORMATS) + FREE_FORMATS
    shapes = [date_shape(f) for f in tries]
    if None in shapes:
        found = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in tries])
    else:
        form = F.lit(None).cast("string")
        for f, shape in reversed(list(zip(tries, shapes, strict=True))):
            form = F.when(plain.rlike(shape), F.lit(f)).otherwise(form)
        found = F.try_to_timestamp(plain, form)
    return F.when(~is_null(c, tokens), found).cast("timestamp_ntz")


def normalise_header(name: str, steps: dict | None = None) -> str:
    steps = HEADER_STEPS | (steps or {})
    out = name.strip()
    if steps["lowercase"]:
        out = out.lower()
    for step, char in (("spaces_to_underscore", " "), ("hyphens_to_underscore", "-"), ("dots_to_underscore", ".")):
        if steps[step]:
            out = out.replace(char, "_")
    if steps["strip_special_chars"]:
        out = "".join(c for c in out if c == "_" or c.isascii() and (c.islower() or c.isdigit()))
    if steps["collapse_underscores"]:
        while "__" in out:
            out = out.replace("__", "_")
    return out.strip("_") if steps["strip_leading_trailing_underscores"] else out


def normalise_header_column(c: Column) -> Column:
    """normalise_header with all its steps, on a column of names."""
    out = F.translate(F.lower(strip(c)), " -.", "___")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9_]", ""), "_+", "_")
    return F.regexp_replace(out, "^_|_$", "")


def clean_text(c: Column) -> Column:
    """Without control characters but tab and line breaks; runs of spaces are one."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), " +", " ")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark has no function for; ASCII passes as it is."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, pair by pair."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def fingerprint(names: Column) -> Column:
    """SHA-256 of an array of header names, whatever their order and case."""
    return F.sha2(F.array_join(F.array_sort(F.transform(names, lambda x: F.lower(strip(x)))), "|"), 256)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
