"""Settings from TOML files: a runtime section and the sources, as typed objects and as a table."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

ROOT_VARIABLE = "STRATAL_ROOT"


@dataclass
class Runtime:
    root: str = "runtime"
    timezone: str = "UTC"
    agents: int = 3
    idle_seconds: int = 900
    history_days: int = 30

    def __post_init__(self):
        for f in fields(self):
            value, kind = getattr(self, f.name), int if f.type == "int" else str
            if not isinstance(value, kind) or isinstance(value, bool):
                raise TypeError(f"runtime.{f.name} has to be {kind.__name__}: {value!r}")
            if kind is int and value < 1:
                raise ValueError(f"runtime.{f.name} has to be at least 1: {value}")


@dataclass
class Source:
    name: str
    enabled: bool = True
    options: dict[str, Any] = field(default_factory=dict)


def read_toml(path: str | Path) -> dict[str, Any]:
    with Path(path).open("rb") as handle:
        return tomllib.load(handle)


def first_existing(name: str, folder: str | Path, explicit: str | Path | None = None) -> Path:
    """The explicit path, else <name>.toml in the folder, else <name>.example.toml."""
    if explicit:
        return Path(explicit).expanduser()
    own = Path(folder) / f"{name}.toml"
    return own if own.exists() else Path(folder) / f"{name}.example.toml"


def runtime(path: str | Path) -> Runtime:
    """The runtime section; unknown keys and wrong types are errors, the root may be overridden by the environment."""
    values = read_toml(path)
    unknown = sorted(set(values) - {f.name for f in fields(Runtime)})
    if unknown:
        raise ValueError(f"unknown runtime settings: {', '.join(unknown)}")
    override = os.environ.get(ROOT_VARIABLE)
    return Runtime(**values | ({"root": override} if override else {}))


def sources(path: str | Path) -> list[Source]:
    """One source a table, one for every entry of a list of tables (named <list>:<id>); `enabled` is true unless it says otherwise."""
    out = []
    for name, value in read_toml(path).items():
        entries = [(name, value)] if isinstance(value, dict) else [(f"{name}:{v['id']}", v) for v in value]
        out += [Source(n, bool(v.get("enabled", True)), {k: x for k, x in v.items() if k != "enabled"}) for n, v in entries]
    names = [s.name for s in out]
    if len(set(names)) < len(names):
        raise ValueError("a source is named twice")
    return out


def as_table(spark: SparkSession, found: list[Source]) -> DataFrame:
    """name, enabled, options (each as JSON text) of the sources, to be joined with observations."""
    rows = [(s.name, s.enabled, {k: json.dumps(v, sort_keys=True, ensure_ascii=False, default=str) for k, v in s.options.items()}) for s in found]
    return spark.createDataFrame(rows, "name string, enabled boolean, options map<string,string>")
