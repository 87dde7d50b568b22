"""Settings, from a TOML file where there is one."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.blocking import Retrieval
from .operators.model import Boosting


@dataclass(frozen=True)
class Config:
    data: str = "data"
    work: str = "work"
    output: str = "output"
    dim: int = 128
    buckets: int = 1 << 14
    fit_sample: int = 200_000
    train_entities: int = 300_000
    holdout: float = 0.2
    folds: int = 5
    seed: int = 42
    projectors: bool = True
    retrieval: Retrieval = field(default_factory=Retrieval)
    model: Boosting = field(default_factory=Boosting)

    def source(self, split: str, source: int) -> str:
        return f"{self.data}/{split}_source{source}.tsv"

    @property
    def truth(self) -> str:
        return f"{self.data}/train_truth.tsv"


def _part(kind, values: dict):
    names = {f.name for f in fields(kind)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def load(path: str | None = None) -> Config:
    """The named file, else ``config.toml``, else ``config.example.toml``, else the defaults; relative paths start at the file's folder."""
    chosen = next((p for p in map(Path, [path] if path else ["config.toml", "config.example.toml"]) if p.exists()), None)
    if chosen is None:
        if path:
            raise FileNotFoundError(path)
        return Config()
    values = tomllib.loads(chosen.read_text())
    nested = {"retrieval": _part(Retrieval, values.pop("retrieval", {})), "model": _part(Boosting, values.pop("model", {}))}
    for name in ("data", "work", "output"):
        if name in values and "://" not in values[name] and not values[name].startswith("/"):
            values[name] = str(chosen.resolve().parent / values[name])
    return _part(Config, values | nested)
