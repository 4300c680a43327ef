"""Plug-in features: indexes built from entity tables once and queried by request."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..runtime import saved
from . import hierarchy


class Feature(Protocol):
    name: str

    def build(self, tables: dict[str, DataFrame]) -> DataFrame: ...

    def query(self, index: DataFrame, **request) -> DataFrame: ...


class Database:
    """Tables with the indexes of installed features, written when first asked for and dropped with their location."""

    def __init__(self, tables: dict[str, DataFrame], features: list[Feature]):
        self.tables, self.features, self.built = dict(tables), {f.name: f for f in features}, {}

    def query(self, feature: str, **request) -> DataFrame:
        f = self.features[feature]
        if feature not in self.built:
            self.built[feature] = saved(f.build(self.tables), f"feature-{feature}")
        return f.query(self.built[feature], **request)

    def changed(self, table: str, rows: DataFrame) -> None:
        self.tables[table] = rows
        self.built.clear()


class Usages:
    """Callers by callee and opcode over calls(callee, caller, opcode, location)."""

    name = "usages"

    def build(self, tables: dict[str, DataFrame]) -> DataFrame:
        return tables["calls"].select("callee", "caller", "opcode", "location").distinct()

    def query(self, index: DataFrame, callees: DataFrame, opcodes: list[str] | None = None) -> DataFrame:
        return hierarchy.usages(index, callees, opcodes)
