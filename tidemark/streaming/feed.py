"""The change log as a Structured Streaming source.

    spark.dataSource.register(ChangeFeed)
    spark.readStream.format("tidemark_changes").option("root", path).option("entity", "1").load()

An offset is a commit number, a partition one parquet file of a commit; a micro-batch holds
whole commits, at most ``max_commits`` of them or ``max_bytes`` of changes, one at least.
Images are JSON by field id.  With the option ``catalog`` schema changes come too, as rows
without a key, ahead of the row changes that use them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.errors import HorizonError

SCHEMA = "commit_seq long, commit_ts long, pk long, kind string, schema_version long, before string, after string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Event(InputPartition):
    def __init__(self, row: tuple):
        self.row = row


class _Log:
    """The commits of one table under a root folder; each manifest is read once."""

    def __init__(self, options: dict):
        self.root, self.entity = Path(options["root"]), options["entity"]
        self.catalog = options.get("catalog", "false").lower() == "true"
        self.max_commits = int(options.get("max_commits", 1_000_000))
        self.max_bytes = int(options.get("max_bytes", 1 << 62))
        self.known: dict[int, dict] = {}

    def commits(self) -> list[dict]:
        for p in (self.root / "manifests").glob("*.json"):
            if int(p.stem) not in self.known:
                doc = json.loads(p.read_text())
                self.known[doc["seq"]] = {k: doc[k] for k in ("seq", "ts", "epoch", "kind", "note")} | {"own": doc["entities"].get(self.entity)}
        return [self.known[k] for k in sorted(self.known)]

    def wanted(self) -> list[dict]:
        return [c for c in self.commits() if c["own"] or (self.catalog and c["kind"] == "schema")]

    def page_end(self, after: int) -> int:
        taken = size = 0
        last = after
        for c in self.wanted():
            if c["seq"] <= after:
                continue
            size += (c["own"] or {}).get("bytes", 0)
            if taken and (taken == self.max_commits or size > self.max_bytes):
                return last
            taken, last = taken + 1, c["seq"]
        return max([c["seq"] for c in self.commits()], default=after)

    def partitions(self, after: int, upto: int | None = None) -> list[InputPartition]:
        horizon = self.root / "horizon.json"
        gone = json.loads(horizon.read_text()).get(self.entity, 0) if horizon.exists() else 0
        out: list[InputPartition] = []
        for c in self.wanted():
            if c["seq"] <= after or (upto is not None and c["seq"] > upto):
                continue
            if c["own"]:
                if c["seq"] <= gone:
                    raise HorizonError(f"changes up to commit {gone} were vacuumed; what follows it can be read")
                folder = self.root / "log" / f"t{self.entity}" / f"c{c['seq']:012d}"
                out += [_File(str(p)) for p in sorted(folder.glob("*.parquet"))]
            else:
                out.append(_Event((c["seq"], c["ts"], None, "drop_table" if c["note"].startswith("DropTable") else "schema", c["epoch"], None, c["note"])))
        return out


def _rows(partition: InputPartition) -> Iterator[tuple]:
    import pyarrow.parquet as pq

    if isinstance(partition, _Event):
        yield partition.row
        return
    image = lambda v: None if v is None else json.dumps(v, default=lambda b: b.hex())
    for batch in pq.ParquetFile(partition.path).iter_batches(batch_size=8192):
        for r in batch.to_pylist():
            yield r["commit_seq"], r["commit_ts"], r["pk"], r["kind"], r["schema_version"], image(r.get("before")), image(r["after"])


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = _Log(options)
        self.at = self.start = int(options.get("after", 0))

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        self.at = max(self.log.page_end(self.at), self.at)
        return {"seq": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.log.partitions(start["seq"], end["seq"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.log, self.after = _Log(options), int(options.get("after", 0))

    def partitions(self) -> list[InputPartition]:
        return self.log.partitions(self.after)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition)


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
