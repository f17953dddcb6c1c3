"""Settings of a run, read from a file and checked before anything is computed."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What a build needs to know; unknown names, missing ones and wrong types are errors."""

    source: str
    target: str
    train_share: float = 0.6
    validation_share: float = 0.2
    folds: int = 5
    min_txn_count: int = 2
    seed: int = 42
    arms: tuple[str, ...] = ()


def load_settings(path: str | Path) -> Settings:
    """Settings from a .json or .toml file, or from .yaml where that library is there."""
    path = Path(path)
    text = path.read_text()
    if path.suffix == ".json":
        found = json.loads(text)
    elif path.suffix == ".toml":
        found = tomllib.loads(text)
    elif path.suffix in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(text)
    else:
        raise ValueError(f"{path.name}: neither .json, .toml nor .yaml")
    return checked(found)


def checked(found: object) -> Settings:
    if not isinstance(found, dict):
        raise ValueError("settings are a mapping of names to values")
    known = {f.name: f for f in dataclasses.fields(Settings)}
    wrong = [f"unknown: {n}" for n in found if n not in known]
    wrong += [f"missing: {n}" for n, f in known.items() if n not in found and f.default is dataclasses.MISSING]
    types = {"source": str, "target": str, "train_share": (int, float), "validation_share": (int, float), "folds": int, "min_txn_count": int, "seed": int, "arms": (list, tuple)}
    wrong += [f"{n}: {found[n]!r}" for n in known if n in found and (not isinstance(found[n], types[n]) or isinstance(found[n], bool))]
    if wrong:
        raise ValueError("; ".join(wrong))
    settings = Settings(**{n: tuple(v) if n == "arms" else v for n, v in found.items()})
    if not (0 < settings.train_share and 0 < settings.validation_share and settings.train_share + settings.validation_share < 1):
        raise ValueError("shares of training and validation leave nothing to test")
    if settings.folds < 1 or settings.min_txn_count < 1:
        raise ValueError("folds and min_txn_count are 1 at least")
    return settings
