"""The append-only commit log: the source of truth for rows, history and the change feed.

Layout under a root folder:

    manifests/<seq>.json    one per commit; putting it in place is the commit
    log/t<entity>/c<seq>/   parquet of row changes: before and after images by field id
    base/t<entity>/c<seq>/  parquet of the rows as of a commit (compaction)
    index/<name>/c<seq>/    parquet copies sorted by an index's keys
    horizon.json            the last commit of each table whose changes were vacuumed

A manifest that exists is whole; a writer that loses the race for a number gets a
conflict, and a data folder without a manifest is never read.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ConflictError, HorizonError, PoisonedError
from tidemark.sources.catalog import TableSchema
from tidemark.types import SPARK

MAX_STRETCHES = 64
_ARROW = {"BOOLEAN": pa.bool_(), "BIGINT": pa.int64(), "DOUBLE": pa.float64(), "STRING": pa.string(), "BYTES": pa.binary()}


@dataclass
class Commit:
    seq: int
    ts: int
    epoch: int
    kind: str  # data, schema, index
    entities: dict[str, dict] = field(default_factory=dict)  # entity -> rows, keys (None: many)
    catalog: dict | None = None
    note: str = ""
    wall_ms: int = 0


def image_type(t: TableSchema) -> T.StructType:
    """All fields the table ever had, by id."""
    return T.StructType([T.StructField(f"f{f.id}", SPARK[f.type]) for f in t.fields])


def log_type(t: TableSchema) -> T.StructType:
    image = image_type(t)
    return T.StructType(
        [T.StructField(n, T.LongType()) for n in ("commit_seq", "commit_ts", "pk")]
        + [T.StructField("kind", T.StringType()), T.StructField("schema_version", T.LongType()), T.StructField("before", image), T.StructField("after", image)]
    )


class LinkedManifests:
    """Puts a manifest if none has its number, on a POSIX file system: a file that is whole
    is linked to its name.  A store of objects offers the same as a conditional put."""

    def __init__(self, folder: Path):
        self.folder = folder

    def put_if_absent(self, name: str, text: str) -> None:
        """FileExistsError: another has the name.  Any other error leaves it open whether
        the manifest is there."""
        temp = self.folder / f"{name}.{os.getpid()}.{time.time_ns()}.tmp"
        try:
            with open(temp, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.link(temp, self.folder / name)
        finally:
            temp.unlink(missing_ok=True)


class Store:
    def __init__(self, spark: SparkSession, root: str, manifests: LinkedManifests | None = None):
        self.spark, self.root = spark, Path(root)
        self.manifests = manifests or LinkedManifests(self.root / "manifests")
        self.poisoned: str | None = None
        for d in ("manifests", "log", "base", "index"):
            (self.root / d).mkdir(parents=True, exist_ok=True)
        self.commits: list[Commit] = []
        self.horizons: dict[str, int] = {}
        self._stretches: dict[tuple, DataFrame] = {}
        self.refresh()

    # --- commits
    def refresh(self) -> None:
        """Takes in commits that other writers have made."""
        known = {c.seq for c in self.commits}
        for p in sorted((self.root / "manifests").glob("*.json")):
            if int(p.stem) not in known:
                self.commits.append(Commit(**json.loads(p.read_text())))
        self.commits.sort(key=lambda c: c.seq)
        horizon = self.root / "horizon.json"
        self.horizons = json.loads(horizon.read_text()) if horizon.exists() else {}

    def recover(self) -> None:
        """After an ambiguous failure: what the log holds is what was committed."""
        self.refresh()
        self.poisoned = None

    def check_writable(self) -> None:
        if self.poisoned:
            raise PoisonedError(self.poisoned)

    @property
    def head(self) -> int:
        return self.commits[-1].seq if self.commits else 0

    def publish(self, commit: Commit) -> Commit:
        self.check_writable()
        commit.wall_ms = int(time.time() * 1000)
        for entity, own in commit.entities.items():
            own.setdefault("bytes", self.size(int(entity), commit.seq))
        try:
            self.manifests.put_if_absent(f"{commit.seq:012d}.json", json.dumps(commit.__dict__))
        except FileExistsError:
            raise ConflictError(f"commit {commit.seq} was made by another writer") from None
        except OSError as e:
            self.poisoned = f"commit {commit.seq} may or may not have been made ({e}); read the log again"
            raise PoisonedError(self.poisoned) from e
        self.commits.append(commit)
        return commit

    def log_path(self, entity: int, seq: int) -> Path:
        return self.root / "log" / f"t{entity}" / f"c{seq:012d}"

    def size(self, entity: int, seq: int) -> int:
        return sum(p.stat().st_size for p in self.log_path(entity, seq).glob("*.parquet"))

    def write_changes(self, t: TableSchema, seq: int, rows: list[dict]) -> None:
        """A small commit: one parquet file straight from the driver."""
        image = pa.struct([(f"f{f.id}", _ARROW[f.type]) for f in t.fields])
        schema = pa.schema([("commit_seq", pa.int64()), ("commit_ts", pa.int64()), ("pk", pa.int64()), ("kind", pa.string()), ("schema_version", pa.int64()), ("before", image), ("after", image)])
        path = self.log_path(t.entity, seq)
        path.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.Table.from_pylist(rows, schema=schema), path / f"part-{time.time_ns()}.parquet")

    def drop_uncommitted(self, t: TableSchema, seq: int) -> None:
        if all(c.seq != seq for c in self.commits):
            for p in self.log_path(t.entity, seq).glob("*.parquet"):
                p.unlink()

    # --- reads
    def _bases(self, entity: int) -> list[int]:
        return sorted(int(p.name[1:]) for p in (self.root / "base" / f"t{entity}").glob("c*") if (p / "_SUCCESS").exists())

    def log(self, t: TableSchema, after: int = 0, upto: int | None = None) -> DataFrame:
        """Row changes of one table with after < commit_seq <= upto."""
        wanted = self.commits_of(t, after, upto)
        if not wanted:
            return self.spark.createDataFrame([], log_type(t))
        horizon = self.horizon(t)
        if wanted[0].seq <= horizon:
            raise HorizonError(f"changes of {t.name} up to commit {horizon} were vacuumed; what follows it can be read")
        # Commits never change, so the files of a stretch of the log are listed once.
        key = (t.entity, len(t.fields), wanted[0].seq, wanted[-1].seq)
        if key not in self._stretches:
            if len(self._stretches) >= MAX_STRETCHES:
                self._stretches.clear()
            self._stretches[key] = self.spark.read.schema(log_type(t)).parquet(*(str(self.log_path(t.entity, c.seq)) for c in wanted))
        return self._stretches[key]

    def commits_of(self, t: TableSchema, after: int = 0, upto: int | None = None) -> list[Commit]:
        return [c for c in self.commits if str(t.entity) in c.entities and c.seq > after and (upto is None or c.seq <= upto)]

    def horizon(self, t: TableSchema) -> int:
        """The last commit of the table whose changes are gone; 0 if all are there.  A base
        holds the rows as they were then."""
        return self.horizons.get(str(t.entity), 0)

    def drop_log(self, t: TableSchema, seqs: list[int]) -> None:
        """Vacuums the oldest commits of a table.  The horizon is written first, so a
        reader meets either the changes or the error that names it."""
        if not seqs:
            return
        self.horizons[str(t.entity)] = max(seqs)
        temp = self.root / f"horizon.{time.time_ns()}.tmp"
        temp.write_text(json.dumps(self.horizons))
        os.replace(temp, self.root / "horizon.json")
        for seq in seqs:
            shutil.rmtree(self.log_path(t.entity, seq), ignore_errors=True)

    def touched_since(self, t: TableSchema, after: int) -> set[int] | None:
        """Keys that commits after ``after`` wrote; None if some commit doesn't list them."""
        out: set[int] = set()
        for c in self.commits:
            own = c.entities.get(str(t.entity))
            if c.seq > after and own:
                if own["keys"] is None:
                    return None
                out.update(own["keys"])
        return out

    def rows(self, t: TableSchema, as_of: int | None = None) -> DataFrame:
        """pk, commit_seq, schema_version and the image of every row at a commit."""
        upto = self.head if as_of is None else as_of
        base = max([b for b in self._bases(t.entity) if b <= upto], default=0)
        parts = []
        if base:
            shape = T.StructType([T.StructField("pk", T.LongType()), T.StructField("commit_seq", T.LongType()), T.StructField("schema_version", T.LongType()), *image_type(t)])
            compacted = self.spark.read.schema(shape).parquet(str(self.root / "base" / f"t{t.entity}" / f"c{base:012d}"))
            if not self.commits_of(t, base, upto):
                return compacted  # a plain scan: filters and columns reach the files
            parts.append(compacted.select("pk", "commit_seq", F.lit("put").alias("kind"), "schema_version", F.struct(*[f"f{f.id}" for f in t.fields]).alias("after")))
        parts.append(self.log(t, base, upto).select("pk", "commit_seq", "kind", "schema_version", "after"))
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        newest = changes.groupBy("pk").agg(F.max("commit_seq").alias("commit_seq"), F.max_by(F.struct("kind", "schema_version", "after"), "commit_seq").alias("r")).where("r.kind <> 'delete'")
        return newest.select("pk", "commit_seq", "r.schema_version", *[F.col(f"r.after.f{f.id}").alias(f"f{f.id}") for f in t.fields])

    def compact(self, t: TableSchema, at: int | None = None) -> int:
        """Writes the rows at a commit (the head) as a new base, sorted by key; the log stays."""
        seq = self.head if at is None else at
        if seq in self._bases(t.entity):
            return seq
        path = self.root / "base" / f"t{t.entity}" / f"c{seq:012d}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.rows(t, seq).repartitionByRange(n, "pk").sortWithinPartitions("pk").write.mode("overwrite").parquet(str(path))
        return seq


    # --- copies of some columns, sorted by others
    def write_copy(self, t: TableSchema, path: str, at: int, fields: list, order: list[tuple[int, bool]]) -> None:
        """Images of ``fields`` (with the key) of all rows at a commit, range-partitioned and
        sorted by ``order``: (field id, descending)."""
        keys = [F.col(f"f{i}").desc_nulls_first() if down else F.col(f"f{i}").asc_nulls_last() for i, down in order]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        rows = self.rows(t, at).select("pk", "commit_seq", "schema_version", *[f"f{f.id}" for f in fields])
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)

    def read_copy(self, t: TableSchema, path: str, watermark: int, at: int, fields: list) -> DataFrame:
        """The rows of a copy of commit ``watermark``, brought forward to commit ``at`` by the
        changes between: keys that were written since leave the copy, their newest images
        come in.  Only the change log since then is read beside the copy."""
        columns = ["pk", "commit_seq", "schema_version", *[f"f{f.id}" for f in fields]]
        copy = self.spark.read.parquet(path).select(*columns)
        if not self.commits_of(t, watermark, at):
            return copy
        log = self.log(t, watermark, at)
        newest = log.groupBy("pk").agg(F.max("commit_seq").alias("commit_seq"), F.max_by(F.struct("kind", "schema_version", "after"), "commit_seq").alias("r"))
        images = newest.where("r.kind <> 'delete'").select("pk", "commit_seq", "r.schema_version", *[F.col(f"r.after.f{f.id}").alias(f"f{f.id}") for f in fields])
        return copy.join(newest.select("pk"), "pk", "left_anti").select(*columns).unionByName(images)


def adapted(rows: DataFrame, t: TableSchema, prefix: str = "", fields: list | None = None) -> DataFrame:
    """Images to the current columns (or those of ``fields``): a field that came after a
    row's version reads its default, one that is stored (NULL too) reads as stored, dropped
    ones vanish."""
    columns = []
    for f in t.active if fields is None else fields:
        stored = F.col(f"{prefix}f{f.id}")
        if f.introduced > 1 and f.has_default and f.default is not None:
            stored = F.when(F.col("schema_version") < f.introduced, F.lit(f.default).cast(SPARK[f.type])).otherwise(stored)
        columns.append(stored.alias(f.name))
    return rows.select(*columns)
