"""The engine's front door: SQL, transactions, history, feed, statistics and reports."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import types
from tidemark.adaptive.advisor import Advisor
from tidemark.adaptive.actuator import Controller
from tidemark.adaptive.consistency import ReadContext, decide
from tidemark.adaptive.feedback import FeedbackLog
from tidemark.adaptive.plan_cache import PlanCache, statement_key
from tidemark.adaptive.statistics import analyze_table
from tidemark.adaptive.telemetry import QueryEvent, Telemetry, query_shape
from tidemark.errors import BindError, CatalogError, ConflictError, ConsistencyError, NotFoundError
from tidemark.plans import ast
from tidemark.plans.binder import bind_select
from tidemark.plans.estimator import TableStatistics, q_error
from tidemark.plans.parser import parse
from tidemark.plans.planner import Plan, Planner
from tidemark.sources.catalog import Catalog, TableSchema, check_value
from tidemark.sources.retention import Retention, Segment, prunable
from tidemark.sources.store import Commit, Store, adapted
from tidemark.streaming.projections import ProjectionRegistry


@dataclass(frozen=True)
class Column:
    name: str
    type: str | None
    may_be_nan: bool = False


class Table:
    """What the binder and the planner see of a table."""

    def __init__(self, engine: Engine, name: str, columns: list[Column], primary_key: str | None, references: dict, scan: Callable, indexes: list):
        self.name, self.columns, self.primary_key, self.indexes = name, columns, primary_key, indexes
        self._engine, self._references, self._scan = engine, references, scan
        self._by_name = {c.name.lower(): c for c in columns}

    def column(self, name: str) -> Column | None:
        return self._by_name.get(name.lower())

    def reference(self, column: str):
        return self._references.get(column)

    def scan(self, as_of: int | None, columns: list[str]) -> DataFrame:
        return self._scan(as_of).select(*[F.col(f"`{c}`") for c in columns])

    @property
    def statistics(self) -> TableStatistics | None:
        return self._engine.statistics.get(self.name.lower())

    @property
    def head(self) -> int:
        return self._engine.head


class IndexProjection:
    """Sorted parquet copies of a table's key, included and primary-key columns.  The change
    log keeps them up to date: a read takes the newest copy at or before its commit and the
    changes since, so writes never wait for an index and snapshots are served as well."""

    def __init__(self, engine: Engine, schema):
        self.engine, self.schema = engine, schema
        self.name, self.keys, self.include = schema.name, schema.keys, schema.include

    def serves(self, as_of: int | None, head: int) -> bool:
        """Whether a copy and the log answer a read, and the changes to bring in are few
        beside the table."""
        at = head if as_of is None else as_of
        copy = self.schema.copy_for(at)
        if copy is None:
            return False
        t = self.engine.catalog.table(self.schema.table)
        since = self.engine.store.commits_of(t, copy, at)
        if since and since[0].seq <= self.engine.store.horizon(t):
            return False
        rows = sum(c.entities[str(t.entity)]["rows"] for c in self.engine.store.commits_of(t, 0, copy))
        return self.changes(as_of) <= max(MAX_DELTA_ROWS, MAX_DELTA_SHARE * rows)

    def changes(self, as_of: int | None) -> int:
        """Row changes between the copy that a read takes and its commit."""
        at = self.engine.head if as_of is None else as_of
        t = self.engine.catalog.table(self.schema.table)
        return sum(c.entities[str(t.entity)]["rows"] for c in self.engine.store.commits_of(t, self.schema.copy_for(at), at))

    def read(self, as_of: int | None) -> DataFrame:
        return self.engine.read_index(self.schema, as_of)


MAX_DELTA_ROWS, MAX_DELTA_SHARE = 100_000, 0.2


@dataclass
class Session:
    """Settings of one client, and the token of its last write."""

    engine: Engine
    optimizer: str = "cost"
    plan_cache: bool = True
    consistency: tuple = ("READ_YOUR_WRITES",)
    token: int = 0
    max_wait_ms: int = 2000

    def sql(self, text: str) -> DataFrame:
        return self.engine.execute(text, self)


@dataclass
class Transaction:
    """Buffered writes over a snapshot; ``commit`` checks for conflicts and makes them one."""

    engine: Engine
    serializable: bool = True
    snapshot: int = 0
    writes: dict[tuple[str, int], dict | None] = field(default_factory=dict)
    reads: set[tuple[str, int]] = field(default_factory=set)

    def get(self, table: str, key: int) -> dict | None:
        at = (table.lower(), key)
        if at in self.writes:
            return self.writes[at]
        self.reads.add(at)
        return self.engine.get(table, key, self.snapshot)

    def put(self, table: str, row: dict) -> None:
        t = self.engine.catalog.table(table)
        self.writes[(table.lower(), row[t.primary_key])] = row

    def delete(self, table: str, key: int) -> None:
        self.writes[(table.lower(), key)] = None

    def commit(self) -> tuple[int, int]:
        """(commit_ts, commit_seq); the head if nothing was written."""
        e = self.engine
        if not self.writes:
            return e.head, e.head
        e.store.refresh()
        checked = set(self.writes) | (self.reads if self.serializable else set())
        for name in {t for t, _ in checked}:
            touched = e.store.touched_since(e.catalog.table(name), self.snapshot)
            if touched is None or any((name, k) in checked for k in touched):
                raise ConflictError(f"rows of {name} were written since commit {self.snapshot}")
        return e._commit_rows(self.writes, self.snapshot)


class Engine:
    """A database under ``root``; imported parquet tables are read-only and beside it."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.clock = spark, clock
        self.store = Store(spark, root)
        docs = [c.catalog for c in self.store.commits if c.catalog]
        self.catalog = Catalog.from_json(docs[-1]) if docs else Catalog()
        self.imported: dict[str, Table] = {}
        self.statistics: dict[str, TableStatistics] = {}
        self.projections = ProjectionRegistry(self.store.root / "projections.json", clock)
        self.cache, self.telemetry = PlanCache(), Telemetry()
        self.advisor = Advisor()
        self.controller = Controller(self, clock)
        self.advisor_on, self.adaptive = True, "off"
        self.feedback: list[dict] = []
        self.feedback_log = FeedbackLog(self.store.root / "feedback")
        self._session = Session(self)

    # --- tables
    @property
    def head(self) -> int:
        return self.store.head

    def session(self) -> Session:
        return Session(self)

    def import_parquet(self, name: str, path: str, primary_key: str | None = None, references: dict | None = None, may_hold_nan: bool = True) -> None:
        """A read-only table over parquet files: integers widen to BIGINT, floats to DOUBLE;
        ``may_hold_nan=False`` promises that its DOUBLEs hold none and leaves out the guard
        against NaN, which keeps comparisons from being pushed into the scan."""
        df = self.spark.read.parquet(path)
        columns = [Column(f.name, types.of_spark(f.dataType), may_hold_nan and types.of_spark(f.dataType) == "DOUBLE") for f in df.schema]
        wide = [F.col(f"`{c.name}`").cast(types.SPARK[c.type]).alias(c.name) if c.type in ("BIGINT", "DOUBLE") and df.schema[c.name].dataType != types.SPARK[c.type] else F.col(f"`{c.name}`") for c in columns]
        view = df.select(*wide)

        def scan(as_of):
            if as_of is not None:
                raise BindError(f"{name} has no versions")
            return view

        self.imported[name.lower()] = Table(self, name, columns, primary_key, references or {}, scan, [])

    def lookup(self, name: str) -> Table:
        if name.lower() in self.imported:
            return self.imported[name.lower()]
        t = self.catalog.table(name)
        columns = [Column(f.name, f.type, f.type == "DOUBLE" and self._may_be_nan(t.name, f.name)) for f in t.active]
        indexes = [IndexProjection(self, i) for i in self.catalog.indexes.values() if i.table.lower() == t.name.lower()]
        references = {f.name: f.references for f in t.active if f.references}
        return Table(self, t.name, columns, t.primary_key, references, lambda as_of: adapted(self.store.rows(t, as_of), t), indexes)

    def _may_be_nan(self, table: str, column: str) -> bool:
        s = self.statistics.get(table.lower())
        return s is None or s.modified > 0 or column not in s.columns or s.columns[column].nan > 0

    # --- SQL
    def sql(self, text: str) -> DataFrame:
        return self._session.sql(text)

    def execute(self, text: str, session: Session) -> DataFrame:
        key = statement_key(text, session.optimizer)
        if session.plan_cache and (tree := self.cache.get(key, self.catalog.epoch)) is not None:
            return self._select(tree, session)
        tree = parse(text)
        if isinstance(tree, ast.Select):
            out = self._select(tree, session)
            if session.plan_cache and tree.as_of is None:
                self.cache.offer(key, tree, self.catalog.epoch, len(text))
            return out
        return self._statement(tree, session)

    def plan(self, tree: ast.Select, session: Session, observe: bool = False) -> Plan:
        bound = bind_select(tree, self.lookup)
        if tree.as_of is not None and tree.as_of > self.head:
            raise NotFoundError(f"there is no version {tree.as_of}")

        def allow(table, index) -> bool:
            if tree.as_of is not None:
                return True
            # The log brings a copy to the head, so an index never lags.
            context = ReadContext(session.consistency, self.head, session.token, session.max_wait_ms)
            return decide(context, "Ready", self.head, None, True).kind == "direct"

        return Planner(session.optimizer, allow, observe).plan(bound)

    def _select(self, tree: ast.Select, session: Session) -> DataFrame:
        if session.consistency[0] != "EVENTUAL" and session.token > self.head:
            raise ConsistencyError(f"the session's token {session.token} is beyond the head {self.head}")
        return self.plan(tree, session).df

    def run(self, text: str, session: Session | None = None) -> list:
        """Collects a SELECT and records it in the telemetry, with rows read and estimates."""
        session = session or self._session
        tree = parse(text)
        began = time.perf_counter()
        plan = self.plan(tree, session, observe=True)
        rows = plan.df.collect()
        spent = (time.perf_counter() - began) * 1000
        read = {a: o.get["rows"] for a, o in plan.observed.items() if a != "result"}
        shape = query_shape(bind_select(tree, self.lookup))
        error = q_error(plan.estimates["result"], len(rows))
        self.telemetry.offer(QueryEvent(shape, spent, sum(read.values()), len(rows), error, bool(plan.indexes)))
        self.feedback.append({"shape": shape.id, "estimated": plan.estimates["result"], "actual": len(rows), "q": error})
        for alias, observed in plan.observed.items():
            actual = observed.get["rows"]
            self.feedback_log.write({"at_ms": int(self.clock() * 1000), "shape": shape.id, "operator": alias, "estimated": plan.estimates[alias], "actual": actual, "q": q_error(plan.estimates[alias], actual), "indexes": plan.indexes})
        return rows

    def _report(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _statement(self, tree, session: Session) -> DataFrame:
        done = "status string, commit_seq long"
        if isinstance(tree, ast.Explain):
            return self._report([(line,) for line in self.explain(tree.statement, session, tree.analyze)], "plan string")
        if isinstance(tree, ast.Insert):
            seq = self.insert(tree.table, self._row(tree))[1]
        elif isinstance(tree, ast.Update):
            seq = self.update(tree.table, self._key(tree), {c: v.value for c, v in tree.changes}, {c: v.type for c, v in tree.changes})[1]
        elif isinstance(tree, ast.Delete):
            seq = self.delete(tree.table, self._key(tree))[1]
        elif isinstance(tree, ast.Analyze):
            names = [tree.table] if tree.table else [*self.imported, *self.catalog.tables]
            return self._report([(n, float(self.analyze(n).rows)) for n in names], "table string, rows double")
        elif isinstance(tree, ast.Show):
            return self.show_schema(tree.table) if tree.what == "schema" else self.show_indexes(tree.table)
        elif isinstance(tree, ast.SetOption):
            self._set(tree, session)
            seq = self.head
        else:
            seq = self._define(tree)
        if isinstance(tree, (ast.Insert, ast.Update, ast.Delete)):
            session.token = max(session.token, seq)
        return self._report([("ok", seq)], done)

    def _set(self, s: ast.SetOption, session: Session) -> None:
        if s.name == "consistency":
            session.consistency = s.value
        elif s.name == "optimizer":
            session.optimizer = s.value
        elif s.name == "plan_cache":
            session.plan_cache = s.value == "on"
        elif s.name == "telemetry":
            self.telemetry.mode = s.value
        elif s.name == "advisor":
            self.advisor_on = s.value == "on"
        else:
            self.adaptive = s.value

    # --- definitions
    def _define(self, tree) -> int:
        self.store.check_writable()
        before = self.catalog.to_json()
        try:
            kind, note = "schema", ""
            if isinstance(tree, ast.CreateTable):
                self.catalog.create(tree.table, tree.columns)
            elif isinstance(tree, ast.AddColumn):
                self.catalog.add_column(tree.table, tree.column)
            elif isinstance(tree, ast.RenameColumn):
                self.catalog.rename_column(tree.table, tree.old, tree.new)
            elif isinstance(tree, ast.DropColumn):
                self.catalog.drop_column(tree.table, tree.column)
            elif isinstance(tree, ast.DropTable):
                self.catalog.drop_table(tree.table)
            elif isinstance(tree, ast.CreateIndex):
                kind = "index"
                self.create_index(tree.name, tree.table, tree.keys, tree.include)
                return self.head
            elif isinstance(tree, ast.DropIndex):
                kind = "index"
                self.catalog.drop_index(tree.name)
            note = f"{type(tree).__name__} {getattr(tree, 'table', getattr(tree, 'name', ''))}"
            self.store.publish(Commit(self.head + 1, self.head + 1, self.catalog.epoch, kind, {}, self.catalog.to_json(), note))
        except Exception:
            self.catalog = Catalog.from_json(before)
            raise
        return self.head

    def index_path(self, schema, copy: int) -> str:
        return str(self.store.root / "index" / schema.name.lower() / f"c{copy:012d}")

    def _index_fields(self, schema) -> list:
        t = self.catalog.table(schema.table)
        return [t.find(c) for c in dict.fromkeys([c for c, _ in schema.keys] + schema.include + [t.primary_key])]

    def read_index(self, schema, as_of: int | None = None) -> DataFrame:
        """Keys, included columns and primary keys of all rows at a commit."""
        t, fields = self.catalog.table(schema.table), self._index_fields(schema)
        at = self.head if as_of is None else as_of
        copy = schema.copy_for(at)
        return adapted(self.store.read_copy(t, self.index_path(schema, copy), copy, at, fields), t, fields=fields)

    def create_index(self, name: str, table: str, keys, include=()) -> int:
        """Writes the projection at the head, range-partitioned and sorted by its keys, and
        registers it; it serves the snapshots from that commit on."""
        schema = self.catalog.create_index(name, table, list(keys), list(include), self.head)
        try:
            self._write_index(schema)
            return self.store.publish(Commit(self.head + 1, self.head + 1, self.catalog.epoch, "index", {}, self.catalog.to_json(), f"index {name}")).seq
        except Exception:
            self.catalog.drop_index(name)
            raise

    def _write_index(self, schema) -> None:
        t = self.catalog.table(schema.table)
        self.store.write_copy(t, self.index_path(schema, schema.watermark), schema.watermark, self._index_fields(schema), [(t.find(c).id, d) for c, d in schema.keys])

    def refresh_index(self, name: str) -> None:
        """Adds a copy at the head, from which later reads need fewer changes; older copies
        go on serving older snapshots."""
        schema = self.catalog.indexes[name.lower()]
        if schema.watermark == self.head:
            return
        schema.copies.append(self.head)
        self._write_index(schema)
        self.store.publish(Commit(self.head + 1, self.head + 1, self.catalog.epoch, "index", {}, self.catalog.to_json(), f"refresh {name}"))

    # --- rows
    def _row(self, tree: ast.Insert) -> dict:
        t = self.catalog.table(tree.table)
        names = [t.find(c).name for c in tree.columns] if tree.columns else [f.name for f in t.active]
        if len(names) != len(tree.values) or len(set(names)) != len(names):
            raise BindError("columns and values differ in number")
        for n, v in zip(names, tree.values, strict=True):
            if v.type is not None and v.type != t.find(n).type:
                raise BindError(f"{n} takes {t.find(n).type}, not {v.type}")
        return {n: v.value for n, v in zip(names, tree.values, strict=True)}

    def _key(self, tree) -> int:
        t = self.catalog.table(tree.table)
        if tree.key.column.lower() != t.primary_key.lower() or tree.value.type != "BIGINT":
            raise BindError(f"rows of {t.name} are named by {t.primary_key} = <integer>")
        return tree.value.value

    def begin(self, serializable: bool = True) -> Transaction:
        return Transaction(self, serializable, self.head)

    def insert(self, table: str, row: dict) -> tuple[int, int]:
        t = self.catalog.table(table)
        key = row.get(t.primary_key)
        if key is not None and self.get(table, key) is not None:
            raise ConflictError(f"{t.name} has a row {key}")
        return self._commit_rows({(table.lower(), key): row}, self.head)

    def update(self, table: str, key: int, changes: dict, kinds: dict | None = None) -> tuple[int, int]:
        t = self.catalog.table(table)
        row = self.get(table, key)
        if row is None:
            raise NotFoundError(f"{t.name} has no row {key}")
        for c, v in changes.items():
            f = t.find(c)
            if f.name == t.primary_key:
                raise BindError("the primary key can't change")
            if kinds and kinds.get(c) not in (None, f.type):
                raise BindError(f"{f.name} takes {f.type}")
            row[f.name] = v
        return self._commit_rows({(table.lower(), key): row}, self.head)

    def delete(self, table: str, key: int) -> tuple[int, int]:
        if self.get(table, key) is None:
            raise NotFoundError(f"{table} has no row {key}")
        return self._commit_rows({(table.lower(), key): None}, self.head)

    def get(self, table: str, key: int, as_of: int | None = None) -> dict | None:
        """The row with this key at a commit, under the current columns."""
        t = self.catalog.table(table)
        found = adapted(self.store.rows(t, as_of).where(F.col("pk") == key), t).collect()
        return found[0].asDict() if found else None

    def _commit_rows(self, writes: dict, snapshot: int) -> tuple[int, int]:
        began = time.perf_counter()
        self.store.check_writable()
        seq = self.head + 1
        by_table: dict[str, list] = {}
        for (name, key), row in writes.items():
            by_table.setdefault(name, []).append((key, row))
        entities, written = {}, []
        for name, changes in by_table.items():
            t = self.catalog.table(name)
            keys = [k for k, _ in changes]
            olds = {r["pk"]: r for r in self.store.rows(t, snapshot).where(F.col("pk").isin(keys)).collect()} if self.store.head else {}
            rows = []
            for key, row in changes:
                old = olds.get(key)
                before = None if old is None else {f"f{f.id}": old[f"f{f.id}"] for f in t.fields}
                if row is None:
                    if old is not None:
                        rows.append({"commit_seq": seq, "commit_ts": seq, "pk": key, "kind": "delete", "schema_version": old["schema_version"], "before": before, "after": None})
                    continue
                rows.append({"commit_seq": seq, "commit_ts": seq, "pk": key, "kind": "insert" if old is None else "update", "schema_version": t.version, "before": before, "after": self._image(t, row)})
            self.store.write_changes(t, seq, rows)
            entities[str(t.entity)] = {"rows": len(rows), "keys": keys}
            written.append((t, len(rows)))
        try:
            self.store.publish(Commit(seq, seq, self.catalog.epoch, "data", entities))
        except ConflictError:
            for t, _ in written:
                self.store.drop_uncommitted(t, seq)
            self.store.refresh()
            raise
        for t, n in written:
            if (s := self.statistics.get(t.name.lower())) is not None:
                s.modified += n
            self.telemetry.wrote(t.name, n, (time.perf_counter() - began) * 1e9)
        return seq, seq

    @staticmethod
    def _image(t: TableSchema, row: dict) -> dict:
        """A full image at the current version: defaults are stored for what is left out."""
        given = {t.find(c).name: v for c, v in row.items()}
        out = {}
        for f in t.active:
            value = given.get(f.name, f.default if f.has_default else None) if f.name not in given else given[f.name]
            check_value(f, value)
            out[f"f{f.id}"] = value
        return out

    @staticmethod
    def _image_columns(t: TableSchema, rows: DataFrame) -> list:
        """Columns of the full image at the current version, from a DataFrame with the
        table's columns; those left out take their defaults."""
        have = {c.lower(): c for c in rows.columns}
        image = []
        for f in t.active:
            kind = types.SPARK[f.type]
            value = (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(f.default)).cast(kind)
            if f.not_null:
                value = F.when(value.isNull(), F.raise_error(F.lit(f"{f.name} can't be NULL")).cast(kind)).otherwise(value)
            image.append(value.alias(f"f{f.id}"))
        return image

    def replay(self, table: str, log: DataFrame, order: str) -> list[int]:
        """Loads a history into an empty table: the rows of ``log`` are versions of their
        keys in the order of ``order``, and the k-th version of every key goes into the k-th
        commit from here.  One job writes all of them; returns the commits."""
        t = self.catalog.table(table)
        self.store.check_writable()
        if self.store.commits_of(t):
            raise ConflictError(f"{t.name} has a history already")
        pk = next(f for f in t.active if f.name == t.primary_key)
        images = log.select(F.struct(*self._image_columns(t, log)).alias("after"), F.col(order).alias("at"))
        within = Window.partitionBy("pk").orderBy("at")
        images = images.withColumn("pk", F.col(f"after.f{pk.id}"))
        rows = images.select("pk", "after", F.row_number().over(within).alias("n"), F.lag("after").over(within).alias("before"))
        seq = (F.col("n") + self.head).cast("long")
        kind = F.when(F.col("n") == 1, "insert").otherwise("update")
        rows = rows.select(seq.alias("commit"), seq.alias("commit_seq"), seq.alias("commit_ts"), "pk", kind.alias("kind"), F.lit(t.version).cast("long").alias("schema_version"), "before", "after")
        staged = self.store.log_path(t.entity, 0).with_name(f"replay-{time.time_ns()}")
        rows.repartition("commit").write.partitionBy("commit").parquet(str(staged))
        counts = {r["commit"]: r["n"] for r in self.spark.read.parquet(str(staged)).groupBy("commit").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = []
        try:
            for seq in sorted(counts):
                (staged / f"commit={seq}").rename(self.store.log_path(t.entity, seq))
                done.append(self.store.publish(Commit(seq, seq, self.catalog.epoch, "data", {str(t.entity): {"rows": counts[seq], "keys": None}})).seq)
        finally:
            shutil.rmtree(staged, ignore_errors=True)
        return done

    def commit_many(self, table: str, rows: DataFrame) -> int:
        """One commit of many new rows from a DataFrame with the table's columns (those left
        out take defaults); keys must be new and distinct."""
        t = self.catalog.table(table)
        self.store.check_writable()
        image = self._image_columns(t, rows)
        seq = self.head + 1
        pk = next(f for f in t.active if f.name == t.primary_key)
        made = rows.select(F.struct(*image).alias("after"))
        made = made.select(F.lit(seq).cast("long").alias("commit_seq"), F.lit(seq).cast("long").alias("commit_ts"), F.col(f"after.f{pk.id}").alias("pk"), F.lit("insert").alias("kind"), F.lit(t.version).cast("long").alias("schema_version"), "after")
        path = str(self.store.log_path(t.entity, seq))
        made.write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path).select("pk")
        n, distinct = new.agg(F.count(F.lit(1)), F.count_distinct("pk")).first()
        clash = n != distinct or (self.head and not new.join(self.store.rows(t).select("pk"), "pk", "left_semi").isEmpty())
        if clash:
            self.store.drop_uncommitted(t, seq)
            raise ConflictError(f"keys of {t.name} repeat or exist")
        self.store.publish(Commit(seq, seq, self.catalog.epoch, "data", {str(t.entity): {"rows": n, "keys": None}}))
        if (s := self.statistics.get(t.name.lower())) is not None:
            s.modified += n
        return seq

    # --- history and feed
    def history(self, table: str, key: int | None = None) -> DataFrame:
        """Every version of rows, oldest first within a key, with begin_ts and end_ts (null:
        current); deletions end a version.  After a vacuum the versions that were current
        at its horizon are the oldest that are left."""
        t = self.catalog.table(table)
        horizon = self.store.horizon(t)
        log = self.store.log(t, horizon).select("pk", "commit_seq", "kind", "schema_version", "after")
        if horizon:
            rows = self.store.rows(t, horizon)
            log = log.unionByName(rows.select("pk", "commit_seq", F.lit("insert").alias("kind"), "schema_version", F.struct(*[f"f{f.id}" for f in t.fields]).alias("after")))
        if key is not None:
            log = log.where(F.col("pk") == key)
        order = Window.partitionBy("pk").orderBy("commit_seq")
        versions = log.withColumn("end_ts", F.lead("commit_seq").over(order)).where("kind <> 'delete'")
        return versions.select("pk", F.col("commit_seq").alias("begin_ts"), "end_ts", "schema_version", F.col("after").alias("row"))

    def changes(self, table: str, after: int = 0, max_commits: int | None = None, max_bytes: int | None = None) -> DataFrame:
        """Committed row changes of a table after a commit, in pages of whole commits."""
        return self.store.log(self.catalog.table(table), after, self.next_cursor(table, after, max_commits, max_bytes))

    def next_cursor(self, table: str | None, after: int, max_commits: int | None = None, max_bytes: int | None = None) -> int:
        """Where the page after this one begins: past ``max_commits`` commits, or as many as
        hold ``max_bytes`` of changes, one at least.  Commits of other tables are passed
        over; without a table all count."""
        entity = None if table is None else str(self.catalog.table(table).entity)
        own = [c for c in self.store.commits if c.seq > after and (entity is None or entity in c.entities)]
        taken = size = 0
        for c in own:
            size += sum(e.get("bytes", 0) for k, e in c.entities.items() if entity in (None, k))
            if taken and (taken == max_commits or (max_bytes is not None and size > max_bytes)):
                return own[taken - 1].seq
            taken += 1
        return self.head

    def feed(self, after: int = 0, max_commits: int | None = None, max_bytes: int | None = None) -> DataFrame:
        """The change feed of all tables after a commit, a page of whole commits: schema
        changes (kind "schema" or "drop_table"), which come ahead of the row changes of the
        same commit or later ones, and row changes with images as JSON by field id."""
        upto = self.next_cursor(None, after, max_commits, max_bytes)
        image = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
        out = self.catalog_events(after).where(F.col("commit_seq") <= upto)
        out = out.select("commit_seq", "commit_ts", F.lit(0).alias("place"), F.lit(None).cast("string").alias("table"), "kind", *(F.lit(None).cast(k).alias(n) for n, k in (("pk", "long"), ("schema_version", "long"), ("before", "string"), ("after", "string"))), "note")
        for t in self.catalog.tables.values():
            rows = self.store.log(t, after, upto)
            out = out.unionByName(rows.select("commit_seq", "commit_ts", F.lit(1).alias("place"), F.lit(t.name).alias("table"), "kind", "pk", "schema_version", image("before"), image("after"), F.lit(None).cast("string").alias("note")))
        return out.orderBy("commit_seq", "place", "table", "pk").drop("place")

    def vacuum(self, keep_from: int) -> list[int]:
        """Drops the changes that a base at ``keep_from`` or before makes needless.  Reads of
        older commits, and feeds from before them, are refused from then on with the horizon
        named; projections that had not come so far are marked for a rebuild."""
        gone = []
        for t in self.catalog.tables.values():
            base = max([b for b in self.store._bases(t.entity) if b <= keep_from], default=0)
            seqs = [c.seq for c in self.store.commits_of(t, self.store.horizon(t), base)]
            self.store.drop_log(t, seqs)
            gone += seqs
        self.projections.overtaken(max(gone, default=0))
        return gone

    def retain(self, limits: Retention = Retention(), now_ms: int | None = None) -> list[int]:
        """Prunes each table's change log by the retention rules: what every consumer has
        passed, and what is beyond a limit.  A base of the rows at the new horizon is written
        before anything goes."""
        gone = []
        now = int(self.clock() * 1000) if now_ms is None else now_ms
        for t in self.catalog.tables.values():
            entity = str(t.entity)
            kept = self.store.commits_of(t, self.store.horizon(t))
            cursors = [p.frontier for p in self.projections.projections.values() if p.table.lower() == t.name.lower()] + list(self.projections.offsets.values())
            segments = [Segment(c.seq, c.entities[entity].get("bytes", 0), c.wall_ms) for c in kept]
            seqs = prunable(segments, min(cursors, default=None), self.head, now, limits)
            if seqs:
                self.store.compact(t, max(seqs))
                self.store.drop_log(t, seqs)
                gone += seqs
        self.projections.overtaken(max(gone, default=0))
        return gone

    def verify(self) -> list[str]:
        """Indexes that differ from the rows they should hold."""
        bad = []
        for i in self.catalog.indexes.values():
            t = self.catalog.table(i.table)
            copy = self.read_index(i)
            rows = adapted(self.store.rows(t), t).select(*copy.columns)
            if not copy.exceptAll(rows).isEmpty() or not rows.exceptAll(copy).isEmpty():
                bad.append(i.name)
        return bad

    def catalog_events(self, after: int = 0) -> DataFrame:
        """Schema changes in commit order; they precede the row changes that use them.
        Index commits are not part of the feed."""
        rows = [(c.seq, c.ts, c.epoch, "drop_table" if c.note.startswith("DropTable") else "schema", c.note) for c in self.store.commits if c.seq > after and c.kind == "schema"]
        return self._report(rows, "commit_seq long, commit_ts long, epoch int, kind string, note string")

    def scan_all(self, as_of: int | None = None) -> DataFrame:
        """Every row of every table of the database (diagnostic), absent columns NULL."""
        out = None
        for t in self.catalog.tables.values():
            df = adapted(self.store.rows(t, as_of), t).withColumn("_table", F.lit(t.name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return self.spark.createDataFrame([], "_table string") if out is None else out

    def scan_page(self, table: str, after: int | None, limit: int, as_of: int | None = None) -> list:
        """The rows whose keys follow ``after``, in key order, at one snapshot."""
        t = self.lookup(table)
        df = t.scan(self.head if as_of is None and table.lower() not in self.imported else as_of, [c.name for c in t.columns])
        if after is not None:
            df = df.where(F.col(t.primary_key) > after)
        return df.orderBy(t.primary_key).limit(limit).collect()

    def run_cancellable(self, text: str, group: str) -> list:
        """``run`` under a job group that ``cancel`` ends from another thread."""
        self.spark.sparkContext.setJobGroup(group, text, interruptOnCancel=True)
        try:
            return self.run(text)
        finally:
            self.spark.sparkContext.setJobGroup("", "")

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)

    # --- statistics and reports
    def analyze(self, table: str) -> TableStatistics:
        t = self.lookup(table)
        columns = [c for c in t.columns if c.type is not None]
        old = self.statistics.get(t.name.lower())
        prefixes = {tuple(c for c, _ in i.keys[:k]) for i in t.indexes for k in range(2, len(i.keys) + 1)}
        s = analyze_table(t.scan(None, [c.name for c in columns]), {c.name: c.type for c in columns}, t.primary_key, sorted(prefixes))
        s.commit_seq, s.generation = self.head, (old.generation if old else 0) + 1
        self.statistics[t.name.lower()] = s
        self.cache.clear()
        return s

    def show_schema(self, table: str) -> DataFrame:
        t = self.catalog.table(table)
        return self._report([(h["version"], h["epoch"], h["change"], h["columns"]) for h in t.history], "version int, epoch int, change string, columns string")

    def show_indexes(self, table: str | None = None) -> DataFrame:
        rows = [
            (i.name, i.table, ", ".join(c + (" DESC" if d else "") for c, d in i.keys), ", ".join(i.include), i.usable_from, i.watermark)
            for i in self.catalog.indexes.values() if table is None or i.table.lower() == table.lower()
        ]
        return self._report(rows, "name string, table string, columns string, include string, usable_from_ts long, watermark_ts long")

    def show_projections(self) -> DataFrame:
        rows = [(p.name, p.table, p.state, p.frontier, p.lag(self.head), p.commits_per_ms) for p in self.projections.projections.values()]
        return self._report(rows, "name string, table string, state string, frontier long, lag long, commits_per_ms double")

    def show_session(self, session: Session) -> DataFrame:
        return self._report([(session.optimizer, session.plan_cache, " ".join(map(str, session.consistency)), session.token, self.head)], "optimizer string, plan_cache boolean, consistency string, token long, head long")

    def show_shapes(self) -> DataFrame:
        rows = [(k, ",".join(s.shape.tables), ",".join(".".join(f) for f in s.shape.filters), s.runs, s.ms, s.rows_read, s.rows_out, s.q_error) for k, s in self.telemetry.shapes.items()]
        return self._report(rows, "shape string, tables string, filters string, runs long, ms double, rows_read long, rows_out long, q_error double")

    def show_telemetry(self) -> DataFrame:
        rows = [(e.shape.id, e.ms, e.rows_read, e.rows_out, e.q_error, e.used_index) for e in self.telemetry.samples]
        return self._report(rows, "shape string, ms double, rows_read long, rows_out long, q_error double, used_index boolean")

    def show_writes(self) -> DataFrame:
        return self._report([(t, w.statements, w.rows, w.nanos / 1e6) for t, w in self.telemetry.writes.items()], "table string, statements long, rows long, ms double")

    def show_advice(self, log: bool = False) -> DataFrame:
        events = self.advisor.log if log else [("shown", a) for a in self.advisor.shown.values()]
        return self._report([(w, a.action, a.table, ",".join(a.columns), float(a.ratio), a.runs, a.reason) for w, a in events], "event string, action string, table string, columns string, ratio double, runs long, reason string")

    def show_actions(self, log: bool = False) -> DataFrame:
        if log:
            return self._report(self.controller.log, "event string, name string, reason string")
        return self._report([(o.name, o.advice.table, "pending" if o.pending else "kept") for o in self.controller.owned.values()], "name string, table string, state string")

    def show_cache(self) -> DataFrame:
        return self._report([(len(self.cache), self.cache.bytes, self.cache.hits, self.cache.misses)], "entries long, bytes long, hits long, misses long")

    def explain(self, tree, session: Session, analyze: bool = False) -> list[str]:
        if not isinstance(tree, ast.Select):
            return [f"statement: {type(tree).__name__}"]
        plan = self.plan(tree, session, observe=analyze)
        lines = ["logical:", *(f"  {x}" for x in plan.logical), "decisions:", *(f"  {x}" for x in plan.decisions), "estimates:"]
        lines += [f"  {k}: {v:.1f} rows" for k, v in plan.estimates.items()]
        for r in bind_select(tree, self.lookup).relations:
            s = r.table.statistics
            lines.append(f"statistics of {r.alias}: " + ("none" if s is None else f"{s.rows:.0f} rows{', stale' if s.stale else ''}"))
        lines += ["warnings:", *(f"  {w}" for w in self._warnings(tree, plan))]
        lines += [f"schema epoch: {self.catalog.epoch}", f"indexes used: {', '.join(plan.indexes) or 'none'}", f"read context: {session.consistency[0]}, head {self.head}, token {session.token}"]
        lines.append(f"plan cache: {len(self.cache)} entries")
        if analyze:
            began = time.perf_counter()
            plan.df.write.format("noop").mode("overwrite").save()
            n = plan.observed["result"].get["rows"]
            lines.append(f"profile: {(time.perf_counter() - began) * 1000:.1f} ms, {n} rows")
            for alias, o in plan.observed.items():
                actual = o.get["rows"]
                lines.append(f"  {alias}: {actual} rows, estimated {plan.estimates[alias]:.1f}, q-error {q_error(plan.estimates[alias], actual):.2f}")
        else:
            lines += ["optimized:", *str(plan.df._jdf.queryExecution().optimizedPlan()).split("\n")]
            lines += ["physical:", *plan.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("\n")]
        return lines

    def _warnings(self, tree: ast.Select, plan: Plan) -> list[str]:
        out = []
        for r in bind_select(tree, self.lookup).relations:
            s = r.table.statistics
            if s is None or s.stale:
                out.append(f"{r.alias} has {'no' if s is None else 'stale'} statistics: ANALYZE {r.table.name}")
        out += [f"{step}: every row meets every other" for step in plan.logical if step.startswith("nested loop")]
        return out or ["none"]

    def tick(self) -> list:
        """One round of the adaptive loop: detect, advise and, when allowed, act."""
        if not self.advisor_on:
            return []
        advice = self.advisor.tick(self.telemetry.window(), self)
        self.controller.tick(advice, self.adaptive)
        return advice


__all__ = ["Engine", "Session", "Transaction", "CatalogError"]
