"""Versioned schemas: fields keep their ids for life, old rows are read through adapters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from tidemark.errors import CatalogError, NotFoundError
from tidemark.types import SPARK

# Limits of a schema and of an index.
MAX_FIELDS, MAX_VERSIONS, MAX_TABLES, MAX_DEFAULT = 4096, 65_535, 10_000, 1024
MAX_KEYS, MAX_INCLUDE, MAX_INDEX_NAME = 16, 32, 128


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str
    not_null: bool = False
    default: object = None
    has_default: bool = False
    introduced: int = 1
    dropped: int | None = None
    references: tuple[str, str] | None = None


@dataclass
class TableSchema:
    entity: int
    name: str
    primary_key: str
    fields: list[Field]
    version: int = 1
    history: list[dict] = field(default_factory=list)

    @property
    def active(self) -> list[Field]:
        return [f for f in self.fields if f.dropped is None]

    def find(self, name: str) -> Field:
        for f in self.active:
            if f.name.lower() == name.lower():
                return f
        raise NotFoundError(f"{self.name} has no column {name}")

    def log(self, epoch: int, change: str) -> None:
        self.history.append({"version": self.version, "epoch": epoch, "change": change, "columns": ", ".join(f"{f.name} {f.type}" for f in self.active)})


@dataclass
class IndexSchema:
    name: str
    table: str
    keys: list[tuple[str, bool]]
    include: list[str]
    copies: list[int]  # the commits of which there is a sorted copy, oldest first

    @property
    def usable_from(self) -> int:
        return self.copies[0]

    @property
    def watermark(self) -> int:
        return self.copies[-1]

    def copy_for(self, at: int) -> int | None:
        """The newest copy that is no newer than a commit."""
        return max((c for c in self.copies if c <= at), default=None)


@dataclass
class Catalog:
    """Tables and indexes at one schema epoch; changes return nothing and raise when refused."""

    epoch: int = 0
    next_entity: int = 1
    tables: dict[str, TableSchema] = field(default_factory=dict)
    indexes: dict[str, IndexSchema] = field(default_factory=dict)

    def table(self, name: str) -> TableSchema:
        found = self.tables.get(name.lower())
        if found is None:
            raise NotFoundError(f"no table {name}")
        return found

    def create(self, name: str, columns) -> TableSchema:
        if name.lower() in self.tables:
            raise CatalogError(f"the table {name} exists")
        if len(self.tables) >= MAX_TABLES or len(columns) > MAX_FIELDS:
            raise CatalogError("too many tables or columns")
        keys = [c for c in columns if c.primary_key]
        if len(keys) != 1 or keys[0].type != "BIGINT":
            raise CatalogError("a table has exactly one PRIMARY KEY, of type BIGINT")
        if len({c.name.lower() for c in columns}) != len(columns):
            raise CatalogError("a column name is used twice")
        fields = [self._field(i, c, 1) for i, c in enumerate(columns, 1)]
        self.epoch += 1
        out = TableSchema(self.next_entity, name, keys[0].name, fields)
        self.next_entity += 1  # ids are never given again
        self.tables[name.lower()] = out
        out.log(self.epoch, "create")
        return out

    def _field(self, number: int, c, version: int) -> Field:
        if c.default is not None and c.default.type is not None and c.default.type != c.type:
            raise CatalogError(f"the default of {c.name} is not a {c.type}")
        if c.default is not None and len(str(c.default.value).encode()) > MAX_DEFAULT:
            raise CatalogError(f"the default of {c.name} is too long")
        if c.default is not None and c.default.value is None and c.not_null:
            raise CatalogError(f"{c.name} is NOT NULL but its default is NULL")
        if c.references:
            target = self.table(c.references[0])
            if target.primary_key.lower() != c.references[1].lower() or c.type != "BIGINT":
                raise CatalogError(f"{c.name} may only reference a primary key of its type")
        return Field(number, c.name, c.type, c.not_null, None if c.default is None else c.default.value, c.default is not None, version, None, c.references)

    def _next(self, t: TableSchema) -> None:
        if t.version >= MAX_VERSIONS:
            raise CatalogError("too many versions")
        t.version += 1
        self.epoch += 1

    def add_column(self, name: str, c) -> None:
        t = self.table(name)
        if any(f.name.lower() == c.name.lower() for f in t.active):
            raise CatalogError(f"{t.name} has a column {c.name}")
        if c.primary_key:
            raise CatalogError("a primary key can't be added")
        if c.not_null and c.default is None:
            raise CatalogError(f"{c.name} is NOT NULL and needs a DEFAULT")
        if len(t.fields) >= MAX_FIELDS:
            raise CatalogError("too many columns")
        made = self._field(len(t.fields) + 1, c, t.version + 1)
        self._next(t)
        t.fields.append(made)
        t.log(self.epoch, f"add {c.name}")

    def rename_column(self, name: str, old: str, new: str) -> None:
        t = self.table(name)
        f = t.find(old)
        if old.lower() != new.lower() and any(x.name.lower() == new.lower() for x in t.active):
            raise CatalogError(f"{t.name} has a column {new}")
        self._next(t)
        t.fields[t.fields.index(f)] = replace(f, name=new)
        if t.primary_key == f.name:
            t.primary_key = new
        for i in self.indexes.values():
            if i.table.lower() == t.name.lower():
                i.keys = [(new if c == f.name else c, d) for c, d in i.keys]
                i.include = [new if c == f.name else c for c in i.include]
        t.log(self.epoch, f"rename {old} to {new}")

    def drop_column(self, name: str, column: str) -> None:
        t = self.table(name)
        f = t.find(column)
        if f.name == t.primary_key:
            raise CatalogError("the primary key can't be dropped")
        for i in self.indexes.values():
            if i.table.lower() == t.name.lower() and f.name in [c for c, _ in i.keys] + i.include:
                raise CatalogError(f"the index {i.name} needs {column}")
        self._next(t)
        t.fields[t.fields.index(f)] = replace(f, dropped=t.version)
        t.log(self.epoch, f"drop {column}")

    def drop_table(self, name: str) -> None:
        t = self.table(name)
        for i in self.indexes.values():
            if i.table.lower() == t.name.lower():
                raise CatalogError(f"the index {i.name} is on {t.name}")
        for other in self.tables.values():
            if other is not t and any(f.references and f.references[0].lower() == t.name.lower() for f in other.active):
                raise CatalogError(f"{other.name} references {t.name}")
        self.epoch += 1
        del self.tables[name.lower()]

    def create_index(self, name: str, table: str, keys, include, seq: int) -> IndexSchema:
        t = self.table(table)
        if name.lower() in self.indexes:
            raise CatalogError(f"the index {name} exists")
        if not 0 < len(keys) <= MAX_KEYS or len(include) > MAX_INCLUDE or len(name) > MAX_INDEX_NAME:
            raise CatalogError("an index has too many columns or too long a name")
        named = [t.find(c).name for c, _ in keys]
        more = [t.find(c).name for c in include]
        if len({*named, *more}) != len(named) + len(more):
            raise CatalogError("an index names a column twice")
        out = IndexSchema(name, t.name, [(n, d) for n, (_, d) in zip(named, keys, strict=True)], more, [seq])
        self.indexes[name.lower()] = out
        return out

    def drop_index(self, name: str) -> None:
        if self.indexes.pop(name.lower(), None) is None:
            raise NotFoundError(f"no index {name}")

    # --- documents
    def to_json(self) -> dict:
        return {"epoch": self.epoch, "next_entity": self.next_entity, "tables": [asdict(t) for t in self.tables.values()], "indexes": [asdict(i) for i in self.indexes.values()]}

    @classmethod
    def from_json(cls, doc: dict) -> Catalog:
        out = cls(doc["epoch"], doc["next_entity"])
        for t in doc["tables"]:
            fields = [Field(**{**f, "references": tuple(f["references"]) if f["references"] else None}) for f in t["fields"]]
            out.tables[t["name"].lower()] = TableSchema(t["entity"], t["name"], t["primary_key"], fields, t["version"], t["history"])
        for i in doc["indexes"]:
            out.indexes[i["name"].lower()] = IndexSchema(**{**i, "keys": [tuple(k) for k in i["keys"]]})
        return out


def check_value(f: Field, value) -> None:
    """Type and nullness of one value of a row."""
    if value is None:
        if f.not_null:
            raise CatalogError(f"{f.name} can't be NULL")
        return
    kinds = {"BOOLEAN": bool, "BIGINT": int, "DOUBLE": float, "STRING": str, "BYTES": (bytes, bytearray)}
    if not isinstance(value, kinds[f.type]) or (f.type == "BIGINT" and isinstance(value, bool)):
        raise CatalogError(f"{f.name} takes {f.type}")


def spark_type(f: Field):
    return SPARK[f.type]
