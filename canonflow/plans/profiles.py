"""Saved header shapes: fingerprints, similarity, and the gate of unattended runs."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path


def header_fingerprint(header: list[str]) -> str:
    return hashlib.sha256("|".join(sorted(h.strip().lower() for h in header)).encode()).hexdigest()


def overlap(a: list[str], b: list[str]) -> float:
    x, y = ({h.strip().lower() for h in names} for names in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


@dataclass(frozen=True)
class Match:
    kind: str  # EXACT, PARTIAL or NONE
    overlap: float = 0.0
    profile: dict | None = None


class ProfileStore:
    """Profiles of a domain as JSON files under their whole fingerprint, and an index with their columns."""

    def __init__(self, root: str | Path, domain: str, partial_threshold: float = 0.7):
        self.folder, self.threshold = Path(root) / domain, partial_threshold

    def _write(self, path: Path, value: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2)
        os.replace(name, path)

    def index(self) -> dict[str, dict]:
        path = self.folder / "index.json"
        return json.loads(path.read_text("utf-8")) if path.exists() else {}

    def _path(self, key: str) -> Path:
        return self.folder / f"{key}.json"

    def load(self, key: str) -> dict | None:
        return json.loads(self._path(key).read_text("utf-8")) if self._path(key).exists() else None

    def save(self, name: str, header: list[str], overrides: dict[str, str] | None = None, mappings: list[dict] | None = None) -> str:
        """Saves or updates a shape: new overrides go over older ones, its use count and first date stay."""
        key, now = header_fingerprint(header), datetime.now(UTC).isoformat()
        old = self.load(key) or {}
        profile = {"fingerprint": key, "name": name, "columns": header, "overrides": old.get("overrides", {}) | (overrides or {}), "mappings": mappings if mappings is not None else old.get("mappings"), "use_count": old.get("use_count", 0), "created_at": old.get("created_at", now), "updated_at": now}
        self._write(self._path(key), profile)
        self._write(self.folder / "index.json", self.index() | {key: {"name": name, "columns": header, "use_count": profile["use_count"]}})
        return key

    def match(self, header: list[str]) -> Match:
        """The saved shape, or the most similar one that reaches the threshold."""
        key, index = header_fingerprint(header), self.index()
        if key in index:
            if profile := self.load(key):
                return Match("EXACT", 1.0, profile)
            self._write(self.folder / "index.json", {k: v for k, v in index.items() if k != key})
            index.pop(key)
        best, score = None, 0.0
        for other, entry in index.items():
            if abs(len(entry["columns"]) - len(header)) <= max(0.5 * len(header), 3) and (found := overlap(header, entry["columns"])) > score:
                best, score = other, found
        if best is None or score < self.threshold:
            return Match("NONE", round(score, 3))
        return Match("EXACT" if score == 1.0 else "PARTIAL", round(score, 3), self.load(best))

    def used(self, key: str) -> None:
        if profile := self.load(key):
            profile["use_count"] += 1
            self._write(self._path(key), profile)
            index = self.index()
            index[key]["use_count"] = profile["use_count"]
            self._write(self.folder / "index.json", index)

    def list(self) -> list[dict]:
        return sorted(({"fingerprint": k, **v} for k, v in self.index().items()), key=lambda x: -x["use_count"])

    def delete(self, key: str) -> bool:
        """By fingerprint or its beginning, if only one profile has it."""
        found = [k for k in self.index() if k.startswith(key)]
        if len(found) != 1:
            return False
        self._path(found[0]).unlink(missing_ok=True)
        self._write(self.folder / "index.json", {k: v for k, v in self.index().items() if k != found[0]})
        return True


def gate(match: Match) -> tuple[bool, str]:
    """Whether an unattended run may take a file, and why."""
    if match.kind == "EXACT":
        return True, "header shape is known"
    if match.kind == "PARTIAL":
        return False, f"header shape is similar to profile '{match.profile['name']}' ({match.overlap:.0%}), but not the same"
    return False, "no profile has this header shape"
