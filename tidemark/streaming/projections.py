"""Derived structures fed from the change log: state, frontier, lag, rate; consumer offsets."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

from tidemark.adaptive.consistency import MAX_WAIT_MS
from tidemark.errors import ConsistencyError, NotFoundError

BUILDING, READY, NEEDS_REBUILD, FAILED = "Building", "Ready", "NeedsRebuild", "Failed"


@dataclass
class Projection:
    name: str
    table: str
    state: str = BUILDING
    frontier: int = 0
    commits_per_ms: float | None = None
    error: str = ""

    def lag(self, head: int) -> int:
        return max(0, head - self.frontier)


class ProjectionRegistry:
    """Kept as one JSON file beside the log, replaced as a whole."""

    def __init__(self, path: Path, clock: Callable[[], float] = time.time):
        self.path, self.clock = path, clock
        doc = json.loads(path.read_text()) if path.exists() else {"projections": [], "offsets": {}}
        self.projections = {p["name"]: Projection(**p) for p in doc["projections"]}
        self.offsets: dict[str, int] = doc["offsets"]

    def save(self) -> None:
        temp = self.path.with_suffix(".tmp")
        temp.write_text(json.dumps({"projections": [asdict(p) for p in self.projections.values()], "offsets": self.offsets}))
        os.replace(temp, self.path)

    def register(self, name: str, table: str) -> Projection:
        self.projections[name] = Projection(name, table)
        self.save()
        return self.projections[name]

    def get(self, name: str) -> Projection:
        if name not in self.projections:
            raise NotFoundError(f"no projection {name}")
        return self.projections[name]

    def feed(self, engine, name: str, apply: Callable, max_commits: int = 1000) -> Projection:
        """Hands ``apply(changes)`` the next page of the log; the frontier moves when it
        returns, an error fails the projection where it stood."""
        p = self.get(name)
        if p.state in (FAILED, NEEDS_REBUILD):
            return p
        upto = engine.next_cursor(p.table, p.frontier, max_commits)
        began = self.clock()
        try:
            if upto > p.frontier:
                apply(engine.changes(p.table, p.frontier, max_commits))
        except Exception as e:
            p.state, p.error = FAILED, str(e)[:500]
            self.save()
            raise
        ms = max((self.clock() - began) * 1000, 1e-3)
        if upto > p.frontier:
            p.commits_per_ms = (upto - p.frontier) / ms
        p.frontier = upto
        if p.frontier >= engine.head:
            p.state = READY
        self.save()
        return p

    def rebuild(self, name: str) -> None:
        p = self.get(name)
        p.state, p.frontier, p.error = BUILDING, 0, ""
        self.save()

    def overtaken(self, pruned: int) -> None:
        """Projections whose next commits were pruned can't go on from where they are."""
        for p in self.projections.values():
            if p.frontier < pruned:
                p.state = NEEDS_REBUILD
        self.save()

    def wait(self, engine, name: str, apply: Callable, seq: int, limit_ms: int = 2000) -> Projection:
        """Feeds until the projection is ready and holds commit ``seq``."""
        stop = self.clock() + min(limit_ms, MAX_WAIT_MS) / 1000
        while True:
            p = self.feed(engine, name, apply)
            if p.state == READY and p.frontier >= seq:
                return p
            if p.state in (FAILED, NEEDS_REBUILD) or self.clock() >= stop or seq > engine.head:
                raise ConsistencyError(f"{name} is {p.state} at {p.frontier}, wanted {seq}")

    def commit_offset(self, consumer: str, seq: int) -> None:
        """A durable cursor of a named consumer; it only moves forward."""
        if seq < self.offsets.get(consumer, 0):
            raise ConsistencyError(f"{consumer} is already at {self.offsets[consumer]}")
        self.offsets[consumer] = seq
        self.save()


def maintain_table(engine, table: str, path: str, checkpoint: str):
    """Keeps the newest image of every row of ``table`` under ``path`` (parquet, images as
    JSON), fed by the change stream until it has caught up; returns the finished query.

    A micro-batch merges its newest change per key into the rows that stand, partially
    aggregated, and replaces the folder's current version.
    """
    from pyspark.sql import functions as F

    from tidemark.streaming.feed import ChangeFeed

    spark = engine.spark
    spark.dataSource.register(ChangeFeed)
    entity = engine.catalog.table(table).entity

    def merge(batch, number: int) -> None:
        s = batch.sparkSession
        current = Path(path) / "CURRENT"
        news = batch.select("pk", "commit_seq", "kind", "schema_version", "after")
        if current.exists():
            news = news.unionByName(s.read.parquet(str(Path(path) / current.read_text())))
        newest = news.groupBy("pk").agg(F.max("commit_seq").alias("commit_seq"), F.max_by(F.struct("kind", "schema_version", "after"), "commit_seq").alias("r"))
        # Deletions stay as marks, so that a batch that is replayed can't bring a row back.
        version = f"v{number:09d}"
        newest.select("pk", "commit_seq", "r.kind", "r.schema_version", "r.after").write.mode("overwrite").parquet(str(Path(path) / version))
        temp = current.with_suffix(".tmp")
        temp.write_text(version)
        os.replace(temp, current)

    Path(path).mkdir(parents=True, exist_ok=True)
    stream = spark.readStream.format("tidemark_changes").option("root", str(engine.store.root)).option("entity", str(entity)).load()
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def maintained_rows(spark, path: str):
    """The rows that ``maintain_table`` keeps."""
    current = Path(path) / "CURRENT"
    return spark.read.parquet(str(Path(path) / current.read_text())).where("kind <> 'delete'")
