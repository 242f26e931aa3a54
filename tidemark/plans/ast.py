"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Literal:
    value: object
    type: str | None  # None: the untyped NULL


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    operand: object


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Name | None  # None: COUNT(*)


@dataclass(frozen=True)
class Item:
    expression: object
    alias: str | None


@dataclass(frozen=True)
class TableRef:
    table: str
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, cross
    right: TableRef
    on: object | None


@dataclass(frozen=True)
class SortKey:
    expression: object
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    source: TableRef
    joins: tuple[Join, ...] = ()
    as_of: int | None = None
    where: object | None = None
    group_by: tuple[Name, ...] = ()
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    primary_key: bool = False
    not_null: bool = False
    default: Literal | None = None
    references: tuple[str, str] | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnSpec


@dataclass(frozen=True)
class RenameColumn:
    table: str
    old: str
    new: str


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    keys: tuple[tuple[str, bool], ...]
    include: tuple[str, ...]


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Show:
    what: str  # schema, indexes
    table: str | None


@dataclass(frozen=True)
class Analyze:
    table: str | None


@dataclass(frozen=True)
class SetOption:
    name: str
    value: object


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Literal], ...]
    key: Name
    value: Literal


@dataclass(frozen=True)
class Delete:
    table: str
    key: Name
    value: Literal


@dataclass(frozen=True)
class Explain:
    statement: object
    analyze: bool = False
    extra: dict = field(default_factory=dict, compare=False)
