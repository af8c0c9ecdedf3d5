"""Settings: what is given on the command line, else the environment, else a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from autuario.errors import EngineError


@dataclass(frozen=True)
class Settings:
    """Where the tables are, where generations are published, and bounds of a page and of a pause between requests."""

    root: str = "."
    releases: str = "releases"
    page: int = 8
    pause_seconds: float = 2.5
    files_per_trigger: int = 4

    def __post_init__(self):
        for name, low, high in (("page", 1, 50), ("pause_seconds", 0.5, 60), ("files_per_trigger", 1, 1000)):
            if not low <= getattr(self, name) <= high:
                raise EngineError("limite_invalido", f"{name} is from {low} to {high}.")


def load(given: dict | None = None, environment: dict[str, str] | None = None, file: str | None = None) -> Settings:
    """The settings by precedence; unknown names in the file are refused, values take the setting's type."""
    environment = dict(os.environ) if environment is None else environment
    place = file or environment.get("AUTUARIO_CONFIG")
    held = tomllib.loads(Path(place).read_text(encoding="utf-8")) if place and Path(place).exists() else {}
    known = {f.name: type(f.default) for f in fields(Settings)}
    if odd := sorted(set(held) - set(known)):
        raise EngineError("parametro_invalido", f"Unknown settings: {', '.join(odd)}.")
    out = {}
    for name, kind in known.items():
        for value in ((given or {}).get(name), environment.get(f"AUTUARIO_{name.upper()}"), held.get(name)):
            if value is not None:
                try:
                    out[name] = kind(value)
                except ValueError as x:
                    raise EngineError("parametro_invalido", f"{name} is no {kind.__name__}.") from x
                break
    return Settings(**out)
