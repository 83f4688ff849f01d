"""Domain configurations: discovery, loading, validation and run-time overlays."""

from __future__ import annotations

import copy
import csv
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

PROVIDERS = ("None", "Claude", "OpenAI", "Gemini")
#: What a prompt template may speak of.
PROMPT_FIELDS = ("domain", "source_col", "lookup_context", "options_text")


class ConfigError(ValueError):
    pass


@dataclass
class DomainConfig:
    """A domain's settings, canonical tables and aliases."""

    domain: str
    settings: dict
    model: dict
    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)
    prompt: str | None = None

    def section(self, name: str) -> dict:
        return self.settings.get(name) or {}

    @property
    def tables(self) -> dict[str, dict]:
        return {k: v for k, v in self.model.items() if not k.startswith("_")}

    def columns(self, table: str) -> dict[str, dict]:
        return self.tables[table]["business_columns"]

    def mandatory(self, table: str) -> list[str]:
        return [c for c, spec in self.columns(table).items() if spec.get("mandatory")]

    def targets(self) -> list[tuple[str, str]]:
        return [(t, c) for t in self.tables for c in self.columns(t)]

    @property
    def null_tokens(self) -> list[str]:
        return list(self.section("quality").get("null_values", [""]))

    def checksum(self) -> str:
        return hashlib.sha256(json.dumps([self.settings, self.model], sort_keys=True).encode()).hexdigest()


def discover_domains(root: str | Path) -> list[str]:
    """Folders with both a system configuration and a canonical model."""
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and all((p / f"{p.name}_{x}.json").exists() for x in ("system_config", "canonical_model")))


def load_aliases(path: str | Path) -> dict[str, tuple[str, str]]:
    """Alias rows in file order, aliases in lower case; of an alias that comes twice, the later target counts."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        rows = csv.DictReader(f)
        return {r["source_variation"].strip().lower(): (r["canonical_table"].strip(), r["canonical_column"].strip()) for r in rows if r["source_variation"].strip()}


def load_domain(root: str | Path, domain: str) -> DomainConfig:
    folder = Path(root) / domain
    read = lambda name: json.loads((folder / f"{domain}_{name}.json").read_text("utf-8-sig"))
    prompts = [folder / f"{domain}_prompt.txt", Path(root) / "global_prompt.txt"]
    prompt = next((p.read_text("utf-8") for p in prompts if p.exists()), None)
    out = DomainConfig(domain, read("system_config"), read("canonical_model"), load_aliases(folder / f"{domain}_lookup_table.csv"), prompt)
    if errors := validate(out):
        raise ConfigError("; ".join(errors))
    return out


def validate(config: DomainConfig) -> list[str]:
    """What is wrong with a configuration; empty if it can be used."""
    errors = [f"section '{s}' is missing or no object" for s in ("matching", "quality") if not isinstance(config.settings.get(s), dict)]
    threshold = config.section("quality").get("mandatory_threshold") if not errors else 0
    if not isinstance(threshold, (int, float)) or isinstance(threshold, bool) or not 0 <= threshold <= 100:
        errors.append("quality.mandatory_threshold must be a number from 0 to 100")
    provider = config.section("llm").get("provider", "None") if isinstance(config.settings.get("llm", {}), dict) else None
    if str(provider) not in PROVIDERS:
        errors.append(f"llm.provider must be one of {', '.join(PROVIDERS)}")
    if config.prompt is not None:
        try:
            config.prompt.format(**dict.fromkeys(PROMPT_FIELDS, ""))
        except (KeyError, IndexError, ValueError) as e:
            errors.append(f"the prompt has a field that is not known: {e}")
    tables = {k: v for k, v in config.tables.items() if isinstance(v, dict)}
    if not tables:
        errors.append("the canonical model has no table")
    errors += [f"table '{t}' has no business_columns" for t, v in tables.items() if not isinstance(v.get("business_columns"), dict)]
    return errors


#: Where each run-time threshold is read.
OVERLAYS = {"mandatory_threshold": "quality", "fuzzy_min_similarity": "matching", "llm_disambiguation_required_below": "matching", "confidence_accept_threshold": "llm", "provider": "llm"}


def overlay(config: DomainConfig, contributor: str | None = None, **values) -> DomainConfig:
    """A copy with run-time values in the sections that read them, over a contributor's own sections."""
    settings = copy.deepcopy(config.settings)
    for section, own in settings.get("contributor_overrides", {}).get(contributor, {}).items():
        settings.setdefault(section, {}).update(own)
    for name, value in values.items():
        if name not in OVERLAYS:
            raise ConfigError(f"unknown setting {name}")
        if value is not None:
            settings.setdefault(OVERLAYS[name], {})[name] = value
    out = DomainConfig(config.domain, settings, config.model, config.aliases, config.prompt)
    if errors := validate(out):
        raise ConfigError("; ".join(errors))
    return out
