"""Declared tables, views, models and functions, kept as JSON if a path is given."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import StructField, StructType

from millrace.errors import Refused
from millrace.types import parse_type


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str]]
    options: dict[str, str] = field(default_factory=dict)
    primary_key: list[str] = field(default_factory=list)

    def schema(self) -> StructType:
        return StructType([StructField(n, parse_type(k), True) for n, k in self.columns])

    def types(self) -> dict[str, str]:
        return dict(self.columns)


@dataclass
class View:
    name: str
    sql: str
    columns: list[str] = field(default_factory=list)
    materialized: bool = False
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class ModelDef:
    name: str
    inputs: list[tuple[str, str]]
    outputs: list[tuple[str, str]]
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class FunctionDef:
    name: str
    arguments: list[tuple[str, str]]
    returns: str
    language: str
    body: str


KINDS = {"table": Table, "view": View, "model": ModelDef, "function": FunctionDef}


class Catalog:
    def __init__(self, path: str | None = None):
        self.path = path
        self.entries: dict[str, dict] = {k: {} for k in KINDS}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for kind, items in json.load(f).items():
                    for item in items:
                        pairs = {k: [tuple(x) for x in v] if k in ("columns", "inputs", "outputs", "arguments") and v and isinstance(v[0], list) else v for k, v in item.items()}
                        self.entries[kind][item["name"]] = KINDS[kind](**pairs)

    def save(self) -> None:
        if self.path:
            with open(f"{self.path}.new", "w", encoding="utf-8") as f:
                json.dump({k: [asdict(e) for e in v.values()] for k, v in self.entries.items()}, f, indent=1)
            os.replace(f"{self.path}.new", self.path)

    def get(self, kind: str, name: str):
        if name.lower() not in self.entries[kind]:
            raise Refused(f"no {kind} {name}")
        return self.entries[kind][name.lower()]

    def find(self, kind: str, name: str):
        return self.entries[kind].get(name.lower())

    def add(self, kind: str, entry, replace: bool = False) -> None:
        entry.name = entry.name.lower()
        if not replace and (entry.name in self.entries[kind] or (kind in ("table", "view") and any(entry.name in self.entries[k] for k in ("table", "view")))):
            raise Refused(f"{entry.name} exists")
        if kind == "table":
            entry.schema()
        self.entries[kind][entry.name] = entry
        self.save()

    def drop(self, kind: str, name: str, if_exists: bool = False, materialized: bool | None = None) -> bool:
        found = self.find(kind, name)
        if found is None or (materialized is not None and found.materialized != materialized):
            if found is None and if_exists and not any(self.find(k, name) for k in ("table", "view")):
                return False
            raise Refused(f"no {'materialized ' if materialized else ''}{kind} {name}")
        del self.entries[kind][name.lower()]
        self.save()
        return True

    def rename(self, kind: str, name: str, to: str) -> None:
        entry = self.get(kind, name)
        if any(self.find(k, to) for k in ("table", "view")):
            raise Refused(f"{to} exists")
        del self.entries[kind][name.lower()]
        entry.name = to.lower()
        self.entries[kind][entry.name] = entry
        self.save()
