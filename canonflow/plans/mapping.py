"""Header mapping: which canonical column each source column becomes.

Headers and aliases are metadata, a few hundred strings, and are matched on
the driver; map_headers and gate_headers do the same for tables of headers.
"""

from __future__ import annotations

import difflib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import ConfigError, DomainConfig
from ..functions.text import normalise_header

UNMAPPED = "UNMAPPED"
OVERRIDE, EXACT, FUZZY, LLM, LLM_DISAMBIGUATED, NO_MATCH = "USER OVERRIDE", "EXACT LOOKUP", "FUZZY MATCH", "LLM", "LLM DISAMBIGUATION", "NO MATCH"


@dataclass(frozen=True)
class Mapping:
    """One source column's target."""

    source: str
    normalised: str
    table: str | None
    column: str
    method: str
    confidence: int
    mandatory: bool = False
    met: bool = False
    reasoning: str | None = None
    variant: str | None = None
    propagated: bool = False

    @property
    def mapped(self) -> bool:
        return self.column != UNMAPPED


#: Takes a prompt, gives a JSON text with canonical_table, canonical_column, confidence and reasoning.
Provider = Callable[[str], str]
DEFAULT_PROMPT = 'Source column: "{source_col}"\nKnown aliases:\n{lookup_context}\nCanonical columns:\n{options_text}\nReply with JSON: {{"canonical_table": ..., "canonical_column": ..., "confidence": 0-100, "reasoning": ...}}'


def alias_context(aliases: dict[str, tuple[str, str]]) -> str:
    by_target: dict[tuple[str, str], list[str]] = {}
    for alias, target in aliases.items():
        by_target.setdefault(target, []).append(alias)
    return "\n".join(f"{t}.{c}: {', '.join(sorted(names))}" for (t, c), names in sorted(by_target.items()))


def parse_reply(reply: str) -> dict:
    """The JSON object of a provider's reply, fenced or not; ValueError if there is none."""
    body = reply.strip()
    if body.startswith("```"):
        body = body.strip("`").removeprefix("json").strip()
    out = json.loads(body)  # its error is a ValueError
    if not isinstance(out, dict):
        raise ValueError("the reply is no JSON object")
    return out


def ask(provider: Provider, prompt: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A provider's parsed reply; failed calls are tried again after 1, then 2 seconds, unreadable replies are not."""
    for k in range(attempts):
        try:
            return parse_reply(provider(prompt))
        except ValueError:
            raise
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(2.0**k)
    raise ConfigError("at least one attempt is needed")


def best_alias(name: str, aliases: dict[str, tuple[str, str]]) -> tuple[str | None, float]:
    """The most similar alias, the first of equals."""
    best, score = None, 0.0
    for alias in aliases:
        ratio = difflib.SequenceMatcher(None, name, alias).ratio()
        if ratio > score:
            best, score = alias, ratio
    return best, score


class Mapper:
    def __init__(self, config: DomainConfig, overrides: dict[str, tuple[str, str]] | None = None, provider: Provider | None = None, sleep: Callable[[float], None] = time.sleep):
        m = config.section("matching")
        #: (column, error) of questions that got no answer
        self.failures: list[tuple[str, str]] = []
        self.sleep = sleep
        self.config, self.overrides, self.provider = config, overrides or {}, provider
        self.steps = m.get("normalisation")
        self.least, self.factor = m.get("fuzzy_min_similarity", 0.7), m.get("fuzzy_confidence_multiplier", 0.91)
        self.exact, self.unsure = m.get("exact_confidence", 100), m.get("llm_disambiguation_required_below", 70)
        self.accept = config.section("llm").get("confidence_accept_threshold", 55)
        self.threshold = config.section("quality").get("mandatory_threshold", 80)
        self.context = alias_context(config.aliases)
        self.options = "\n".join(f"{t}.{c}" for t, c in config.targets())

    def is_mandatory(self, table: str, column: str) -> bool:
        return table in self.config.tables and column in self.config.mandatory(table)

    def _to(self, source: str, name: str, target: tuple[str, str], method: str, confidence: int, met: bool | None = None, **more) -> Mapping:
        mandatory = self.is_mandatory(*target)
        return Mapping(source, name, *target, method, confidence, mandatory, confidence >= self.threshold or not mandatory if met is None else met, **more)

    def _asked(self, source: str, name: str, method: str) -> Mapping | None:
        if self.provider is None:
            return None
        template = self.config.prompt or DEFAULT_PROMPT
        try:
            reply = ask(self.provider, template.format(domain=self.config.domain, source_col=source, lookup_context=self.context, options_text=self.options), sleep=self.sleep)
        except Exception as e:  # noqa: BLE001  a provider that fails leaves a column to what is known without it
            self.failures.append((source, f"{type(e).__name__}: {e}"))
            return None
        target, confidence = (reply.get("canonical_table"), reply.get("canonical_column")), int(reply.get("confidence") or 0)
        if confidence < self.accept or not target[0] or target[1] in (None, UNMAPPED):
            return None
        return self._to(source, name, target, method, confidence, reasoning=reply.get("reasoning"))

    def one(self, source: str) -> Mapping:
        """Override, exact alias, similar alias (doubtful ones are asked for), provider, none: the first that hits."""
        name = normalise_header(source, self.steps)
        if source in self.overrides:
            return self._to(source, name, self.overrides[source], OVERRIDE, 100, True)
        if name in self.config.aliases:
            return self._to(source, name, self.config.aliases[name], EXACT, self.exact, variant=name)
        alias, score = best_alias(name, self.config.aliases)
        if alias is not None and score >= self.least:
            confidence = int(score * 100 * self.factor)
            asked = self._asked(source, name, LLM_DISAMBIGUATED) if confidence < self.unsure else None
            return asked or self._to(source, name, self.config.aliases[alias], FUZZY, confidence, variant=alias)
        return self._asked(source, name, LLM) or Mapping(source, name, None, UNMAPPED, NO_MATCH, 0)

    def all(self, header: list[str]) -> list[Mapping]:
        found = [self.one(h) for h in header]
        return found + self.propagated(found)

    def propagated(self, found: list[Mapping]) -> list[Mapping]:
        """Copies of a shared key's mapping for the rule's other tables, once a rule."""
        m = self.config.section("matching")
        out: list[Mapping] = []
        for rule in m.get("shared_key_propagation_rules", []) if m.get("allow_shared_key_multi_target_propagation", True) else []:
            targets = [(t["canonical_table"], t["canonical_column"]) for t in rule.get("targets", [])]
            source = next((x for x in found if (x.table, x.column) in targets), None)
            if len(targets) > 1 and source is not None:
                there = {(x.table, x.column) for x in [*found, *out]}
                out += [replace(source, table=t, column=c, mandatory=self.is_mandatory(t, c), met=True, propagated=True) for t, c in targets if (t, c) not in there]
        return out


MAPPING = "source string, normalised string, canonical_table string, canonical_column string, match_method string, confidence int, was_mandatory boolean, met_threshold boolean, propagated boolean, variant string"


def map_headers(headers: DataFrame, config: DomainConfig, overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Mapper.all for many headers at once: a row (MAPPING) per column of each row's array `header`, and per propagated copy, beside the row's other columns. No provider is asked. Null headers have no columns."""
    own = [f for f in headers.schema.fields if f.name != "header"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(config, overrides)
        for batch in batches:
            at, found = [], []
            for k, names in enumerate(batch.column("header").to_pylist()):
                for x in mapper.all(names or []):
                    at.append(k)
                    found.append((x.source, x.normalised, x.table, x.column, x.method, x.confidence, x.mandatory, x.met, x.propagated, x.variant))
            kinds = [pa.string()] * 5 + [pa.int32()] + [pa.bool_()] * 3 + [pa.string()]
            mapped = [pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(pa.array(at, pa.int64())) for f in own], *mapped], names=[*[f.name for f in own], *MAPPED])

    MAPPED = [x.split()[0] for x in MAPPING.split(", ")]
    return headers.mapInArrow(run, T.StructType([*own, *T._parse_datatype_string(MAPPING).fields]))


def gate_headers(headers: DataFrame, config: DomainConfig) -> DataFrame:
    """The rows of `headers` with `active` (tables) and `blocked` (mandatory columns, TABLE.Column) for their array `header`."""
    own = [f for f in headers.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(config)
        for batch in batches:
            found = [mapper.all(names or []) for names in batch.column("header").to_pylist()]
            active = pa.array([active_tables(x) for x in found], pa.list_(pa.string()))
            blocked = pa.array([[f"{t}.{c}" for t, c in blocked_columns(x, config)] for x in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, active, blocked], names=[*[f.name for f in own], "active", "blocked"])

    texts = T.ArrayType(T.StringType())
    return headers.mapInArrow(run, T.StructType([*own, T.StructField("active", texts), T.StructField("blocked", texts)]))


def active_tables(mappings: list[Mapping]) -> list[str]:
    """Tables with two mapped columns of their own, or more."""
    counts: dict[str, int] = {}
    for x in mappings:
        if x.mapped and not x.propagated:
            counts[x.table] = counts.get(x.table, 0) + 1
    return [t for t, n in counts.items() if n >= 2]


def column_map(mappings: list[Mapping]) -> dict[str, list[tuple[str, str, float]]]:
    out: dict[str, list[tuple[str, str, float]]] = {}
    for x in mappings:
        if x.mapped:
            out.setdefault(x.source, []).append((x.table, x.column, x.confidence))
    return out


def blocked_columns(mappings: list[Mapping], config: DomainConfig) -> list[tuple[str, str]]:
    """Mandatory columns of active tables that no mapping reaches with enough confidence, sorted."""
    threshold = config.section("quality").get("mandatory_threshold", 80)
    best: dict[tuple[str, str], int] = {}
    for x in mappings:
        if x.mapped:
            best[x.table, x.column] = max(x.confidence, best.get((x.table, x.column), 0))
    return sorted((t, c) for t in active_tables(mappings) if t in config.tables for c in config.mandatory(t) if best.get((t, c), 0) < threshold)


def scorecard(mappings: list[Mapping]) -> list[dict]:
    return [{"Source_Column": x.source, "Suggested_Target": f"{x.table}.{x.column}" if x.mapped else UNMAPPED, "Selected_Target": f"{x.table}.{x.column}" if x.mapped else UNMAPPED, "Match_Method": x.method, "Confidence": x.confidence, "Mandatory": x.mandatory, "Met_Threshold": x.met, "Propagated": x.propagated} for x in mappings]


def overrides_from_scorecard(rows: list[dict]) -> dict[str, tuple[str, str]]:
    """Rows whose selected target was changed."""
    return {r["Source_Column"]: parse_target(r["Selected_Target"]) for r in rows if r["Selected_Target"] != r["Suggested_Target"] and r["Selected_Target"] != UNMAPPED}


def parse_target(text: str) -> tuple[str, str]:
    table, dot, column = text.strip().partition(".")
    if not (dot and table and column):
        raise ValueError(f"a target is written TABLE.Column, not {text!r}")
    return table, column


def parse_overrides(source: str | list[str] | dict[str, str] | None) -> dict[str, tuple[str, str]]:
    """From lines or a list of SOURCE=TABLE.Column, a JSON object, or a dict."""
    if not source:
        return {}
    if isinstance(source, str):
        source = json.loads(source) if source.lstrip().startswith("{") else [x for x in source.splitlines() if x.strip()]
    if isinstance(source, list):
        pairs = [x.partition("=") for x in source]
        if bad := next((x for x in pairs if not x[1]), None):
            raise ValueError(f"an override is written SOURCE=TABLE.Column, not {bad[0]!r}")
        source = {a.strip(): b for a, _, b in pairs}
    return {k: parse_target(v) for k, v in source.items()}


def format_overrides(overrides: dict[str, tuple[str, str]]) -> str:
    return "\n".join(f"{k}={t}.{c}" for k, (t, c) in overrides.items())
