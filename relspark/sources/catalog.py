"""The catalog: immutable descriptions of tables, so that a snapshot is a reference."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

ROWID = "_rowid"

_TYPES = {
    **dict.fromkeys(("integer", "int", "tinyint", "smallint", "mediumint", "bigint", "boolean", "bool"), "bigint"),
    **dict.fromkeys(("real", "float", "double", "numeric", "decimal"), "double"),
    **dict.fromkeys(("text", "varchar", "nvarchar", "char", "date", "datetime", "timestamp", "json"), "string"),
    **dict.fromkeys(("blob", "bytes", "binary", "varbinary"), "binary"),
}


def spark_type(declared: str) -> str | None:
    return _TYPES.get(declared.lower())


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # Spark's
    declared: str = ""
    limit: int | None = None  # bytes of UTF-8
    not_null: bool = False
    unique: bool = False
    primary: bool = False
    auto: bool = False
    default: str | None = None
    check: str | None = None
    generated: str | None = None
    stored: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    ref: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    keys: tuple[tuple[str, ...], ...] = ()  # composite PRIMARY KEY and UNIQUE
    foreign: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    temporary: bool = False
    next_id: int = 1
    sql: str = ""
    frame: DataFrame | None = field(default=None, compare=False)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def stored(self) -> list[Column]:
        return [c for c in self.columns if c.generated is None or c.stored]

    @property
    def unique(self) -> list[tuple[str, ...]]:
        single = [(c.name,) for c in self.columns if c.unique or c.primary]
        return list(dict.fromkeys([*single, *self.keys]))

    @property
    def auto_column(self) -> Column | None:
        return next((c for c in self.columns if c.auto or c.primary and c.type == "bigint"), None)


@dataclass(frozen=True)
class Trigger:
    name: str
    when: str  # BEFORE, AFTER or INSTEAD OF
    event: str
    table: str
    of: tuple[str, ...]
    condition: str | None
    body: tuple[str, ...]
    sql: str


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, tuple[str, ...], bool]] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    stats: dict[str, dict[str, Any]] = field(default_factory=dict)
    meta: dict[tuple[str, str, str], str] = field(default_factory=dict)

    def put(self, part: str, key: Any, value: Any) -> Catalog:
        return replace(self, **{part: {**getattr(self, part), key: value}})

    def drop(self, part: str, *keys: Any) -> Catalog:
        return replace(self, **{part: {k: v for k, v in getattr(self, part).items() if k not in keys}})
