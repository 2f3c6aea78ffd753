"""Catalog: node and relationship tables, interfaces, classes, indexes and pins."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from graphquarry.errors import InvalidArgument, NotFound
from graphquarry.types import Type, fold, parse_type, suggestion


@dataclass(frozen=True)
class NodeTable:
    """``frame`` gives the columns and ``__ord``, the insertion order."""

    name: str
    columns: tuple[tuple[str, Type], ...]
    key: str
    frame: Callable[[SparkSession], DataFrame]
    next_ord: int = 0
    added: tuple | None = None  # rows that a folder's version lacks, where nothing else has changed


@dataclass(frozen=True)
class RelTable:
    """``frame`` gives ``__from`` and ``__to`` (endpoint keys), the columns and ``__ord``."""

    name: str
    source: str
    target: str
    columns: tuple[tuple[str, Type], ...]
    frame: Callable[[SparkSession], DataFrame]
    next_ord: int = 0
    added: tuple | None = None


@dataclass(frozen=True)
class Interface:
    name: str
    columns: tuple[tuple[str, Type], ...]


@dataclass(frozen=True)
class Catalog:
    """One immutable version; changes give a new one."""

    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: dict[str, RelTable] = field(default_factory=dict)
    interfaces: dict[str, Interface] = field(default_factory=dict)
    classes: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    pins: dict[str, dict] = field(default_factory=dict)

    def node_table(self, name: str) -> NodeTable:
        return self._found(self.nodes, name, "node table")

    def rel_table(self, name: str) -> RelTable:
        return self._found(self.rels, name, "relationship table")

    def interface(self, name: str) -> Interface:
        if fold(name) in self.nodes:
            raise InvalidArgument(f"{name} is both a node table and an interface")
        return self._found(self.interfaces, name, "interface")

    @staticmethod
    def _found(where: dict, name: str, what: str):
        if fold(name) not in where:
            raise InvalidArgument(f"unknown {what} {name}{suggestion(name, [x.name for x in where.values()])}")
        return where[fold(name)]

    def is_interface(self, name: str) -> bool:
        return fold(name) not in self.nodes and fold(name) in self.interfaces

    def implementers(self, interface: str) -> list[NodeTable]:
        """In the order of the node tables."""
        return [t for k, t in self.nodes.items() if fold(interface) in map(fold, self.classes.get(k, {}).get("implements", ()))]

    def taken(self, name: str) -> bool:
        return any(fold(name) in x for x in (self.nodes, self.rels, self.interfaces))

    def with_(self, kind: str, name: str, value) -> "Catalog":
        return replace(self, **{kind: getattr(self, kind) | {fold(name): value}})

    def without(self, kind: str, name: str) -> "Catalog":
        rest = dict(getattr(self, kind))
        if rest.pop(fold(name), None) is None:
            raise NotFound(f"no {kind[:-1]} named {name}")
        return replace(self, **{kind: rest})

    def summary(self) -> dict:
        """Everything declared, as plain data."""

        def cols(x):
            return [{"name": c, "type": str(t)} for c, t in x.columns]

        return {
            "node_tables": [{"name": t.name, "key": t.key, "columns": cols(t), "class": self.classes.get(k)} for k, t in self.nodes.items()],
            "rel_tables": [{"name": t.name, "from": t.source, "to": t.target, "columns": cols(t), "class": self.classes.get(k)} for k, t in self.rels.items()],
            "interfaces": [{"name": t.name, "columns": cols(t)} for t in self.interfaces.values()],
            "indexes": list(self.indexes.values()),
            "pins": [{"name": p["name"], "text": p["text"]} for p in self.pins.values()],
        }

    def to_json(self, paths: dict[str, list[str]]) -> str:
        return json.dumps(self.summary() | {"pins": list(self.pins.values()), "paths": paths, "next": {k: t.next_ord for k, t in (self.nodes | self.rels).items()}})

    @staticmethod
    def from_json(text: str) -> tuple["Catalog", dict[str, list[str]]]:
        d = json.loads(text)
        out = Catalog()

        def cols(x):
            return tuple((c["name"], parse_type(c["type"])) for c in x["columns"])

        def reader(name):
            folders = d["paths"][fold(name)]
            return lambda spark: spark.read.parquet(*folders)

        for x in d["node_tables"]:
            out = out.with_("nodes", x["name"], NodeTable(x["name"], cols(x), x["key"], reader(x["name"]), d["next"][fold(x["name"])], ()))
        for x in d["rel_tables"]:
            out = out.with_("rels", x["name"], RelTable(x["name"], x["from"], x["to"], cols(x), reader(x["name"]), d["next"][fold(x["name"])], ()))
        for x in d["interfaces"]:
            out = out.with_("interfaces", x["name"], Interface(x["name"], cols(x)))
        for x in d["node_tables"] + d["rel_tables"]:
            if x["class"]:
                out = out.with_("classes", x["name"], x["class"])
        for x in d["indexes"]:
            out = out.with_("indexes", x["name"], x)
        for x in d["pins"]:
            out = out.with_("pins", x["name"], x)
        return out, d["paths"]
