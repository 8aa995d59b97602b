"""Named sources with checksums, and parameters by card: explicit before profile before default."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from strandmill.gates import GateError


def sha256_of(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(4 << 20):
            h.update(block)
    return h.hexdigest()


@dataclass
class SourceRegistry:
    """``{name: {"path": …, "anchor": file, "sha256": …}}``; a source is given out only if its anchor file has its checksum."""

    root: Path
    sources: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> SourceRegistry:
        p = Path(path)
        return cls(p.parent, json.loads(p.read_text(encoding="utf-8")))

    def resolve(self, name: str) -> Path:
        if name not in self.sources:
            raise GateError(f"unknown source {name}")
        card = self.sources[name]
        path = self.root / card["path"]
        if not path.exists():
            raise GateError(f"{name}: {path} is missing")
        if "sha256" in card:
            anchor = path / card["anchor"] if card.get("anchor") else path
            if sha256_of(anchor) != card["sha256"]:
                raise GateError(f"{name}: checksum of {anchor} differs")
        return path


def resolve_parameters(explicit: dict[str, Any], profile: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """Each parameter from the first of the three that has a value other than None."""
    names = {*explicit, *profile, *defaults}
    first = lambda n: next((d[n] for d in (explicit, profile, defaults) if d.get(n) is not None), None)
    return {n: first(n) for n in sorted(names)}


def load_card(path: str | Path, required: tuple[str, ...] = ()) -> dict[str, Any]:
    """A JSON card (topic, cohort, recipe) with its required keys."""
    card = json.loads(Path(path).read_text(encoding="utf-8"))
    if missing := [k for k in required if k not in card]:
        raise GateError(f"{path}: missing {missing}")
    return card
