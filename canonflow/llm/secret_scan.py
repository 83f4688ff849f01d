"""Secret scan with multipart credential linking, in DataFrame functions alone.

Base kinds stand by themselves (assign, access, hex).  Weak candidates (ident:
an account or client identifier; value: a long mixed token; endpoint: a URL)
say little alone.  Each identifier, base access keys included, opens the
interval of `reach` code points around it; overlapping intervals are merged
into scopes.  Secrets and endpoints are joined to the scopes that overlap
them, and a scope's weak candidates are reported only if the scope also holds
a secret that complements its identifiers: another text than an identifier's
own, and, but for assignments, no part of an endpoint.

The joins are sorted merges of the intervals of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import let, merged, overlapping, running
from .state import unused

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?:[Aa][Cc][Cc][Ee][Ss][Ss]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]|[Tt][Ee][Nn][Aa][Nn][Tt]|[Uu][Ss][Ee][Rr])[_-]?(?:[Kk][Ee][Yy][_-]?)?(?:[Ii][Dd]|[Nn][Aa][Mm][Ee])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
VALUE = r"[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~%@:/?#&=+-]+"
#: Place of a kind among spans that start together.
KINDS = ["assign", "access", "hex", "ident", "value", "endpoint"]
SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Code points of the parts in which a text is cut for redaction.
PART = 1024


def found(text: Column, pattern: str, rank: int, keep=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end) in code points. keep: a predicate on the group's text; matches that fail it are dropped, but have consumed their text."""
    none = F.array().cast(SPAN)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def placed(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["before"]) + F.length(F.coalesce(x["hit"], F.lit(""))))
        spans = let(running(lengths, lambda a, b: a + b, 0), lambda ends: F.transform(p, lambda x, i: F.struct((F.get(ends, i) - F.length(x["hit"])).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"), x["part"].alias("part"))))
        good = F.filter(spans, lambda s: s["start"].isNotNull() & (F.lit(True) if keep is None else keep(s["part"])))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    return F.coalesce(F.when(text.rlike(pattern), let(parts, placed).cast(SPAN)), none)


def joined_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(documents: DataFrame, text_column: str = "text", reach: int = 300) -> DataFrame:
    """The columns of `documents` and a struct `secrets`: base and all (arrays of start, rank in KINDS, end; sorted), scopes (of linked credentials).

    Null and empty texts have empty arrays. Rows are independent: copies, repeated ids and clashing column names (other than
    `secrets`, which is replaced) don't matter. No exchange; time is linear in a text's length, but for the sorting of spans.
    """
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    none = F.array().cast(SPAN)
    s = documents.drop("secrets")
    steps = {x: unused(s, f"__{x}") for x in ("found", "scopes", "loose", "linked", "weak")}
    col = lambda x: F.col(steps[x])
    s = s.withColumn(
        steps["found"],
        F.struct(
            found(text, ASSIGN, 0, lambda g: F.length(g) >= 6, 2).alias("assign"),
            found(text, ACCESS, 1, lambda g: F.length(g) >= 20).alias("access"),
            found(text, HEX, 2).alias("hex"),
            found(text, IDENT, 3).alias("ident"),
        ),
    )
    f = col("found")
    ids = F.concat(f["access"], f["ident"])
    s = s.withColumn(steps["scopes"], F.when(F.size(ids) > 0, merged(F.sort_array(ids), reach)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    some = F.size(steps["scopes"]) > 0
    values, ends = (F.when(some, x).otherwise(none) for x in (found(text, VALUE, 4, mixed), found(text, ENDPOINT, 5)))
    s = s.withColumn(steps["loose"], F.struct(values.alias("value"), ends.alias("endpoint")))
    loose = col("loose")
    apart = overlapping(F.concat(loose["value"], f["hex"]), F.concat(loose["endpoint"], ids), False)
    own = overlapping(f["assign"], ids, False)
    told = lambda a: F.struct(F.sort_array(let(F.concat(a, own), lambda p: overlapping(col("scopes"), p))).alias("scopes"), F.filter(a, lambda x: x["rank"] == 4).alias("value"))
    s = s.withColumn(steps["linked"], F.when(some, let(apart, told)))
    weak = let(F.concat(f["ident"], col("linked")["value"], loose["endpoint"]), lambda w: overlapping(w, col("linked")["scopes"]))
    s = s.withColumn(steps["weak"], F.when(F.size(col("linked")["scopes"]) > 0, weak).otherwise(none))
    base = F.concat(f["assign"], f["access"], f["hex"])
    scopes = F.coalesce(col("linked")["scopes"], F.array().cast("array<struct<start:int,end:int>>"))
    secrets = F.struct(F.sort_array(base).alias("base"), F.sort_array(F.concat(base, col("weak"))).alias("all"), scopes.alias("scopes"))
    return s.withColumn("secrets", secrets).drop(*steps.values())


def redact(scanned: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Texts of scan_secrets' rows with every reported span replaced by `mark`; overlapping spans become one mark. Texts without spans stay as they are, null included."""
    text, spans = scanned[text_column], scanned["secrets"]["all"]

    def between(parts: Column, a: Column, z: Column) -> Column:
        """Code points a to z, from the parts that hold them."""
        first, last = F.floor(a / PART).cast("int"), F.floor((z - 1) / PART).cast("int")
        piece = lambda k: F.substring(F.get(parts, k), F.greatest(a - k * PART, F.lit(0)) + 1, F.least(z - k * PART, F.lit(PART)) - F.greatest(a - k * PART, F.lit(0)))
        return F.when(z > a, F.array_join(F.transform(F.sequence(first, last), piece), "")).otherwise("")

    def clean(parts: Column, gone: Column) -> Column:
        edge = lambda k: F.coalesce(F.get(gone, k)["start"], F.length(text))
        from_ = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1)["end"])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: between(parts, from_(k), edge(k))), mark)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    cleaned = let(parts, lambda p: let(merged(spans), lambda gone: clean(p, gone)))
    return scanned.withColumn(text_column, F.when(F.size(spans) > 0, cleaned).otherwise(text))
