"""The row-by-column incidence of a corpus, cut down to columns that two rows share.

A row is a document (or a set of texts that are equal), a column is anything hashed to
64 bits that rows contain: a shingle, a band of a signature.  Three passes, all packed: a
shuffled record is a block of many entries, so an entry costs a few bytes and no JVM object.

0. ``heavy_columns`` counts what is frequent within one block of entries.  Columns with more
   than FREQUENT / FLUSH_ENTRIES of all entries are heavy; there are FLUSH_ENTRIES / FREQUENT
   of them at most, whatever the input.
1. Each task sorts the entries it has seen by column and sends them to column buckets
   (ranges of the hash).  A bucket counts how many rows hold each column.  Entries of heavy
   columns are known to be shared and go straight to the row's block, spread over all tasks,
   so no task holds the entries of one common column.
2. Entries of columns held by two rows or more go back to the row's block, where
   ``finish`` sees every shared column of each row.

Columns keep all 64 bits of their hash; two of them are taken for one only if these agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, grouped, mix, pack, release, slices, unpack

FLUSH_ENTRIES = 5 << 18
BUCKET_ENTRIES = 5 << 18
FREQUENT = 16
BATCH_BYTES = 4 << 20
MARKED = int(np.iinfo(np.int64).min)  # stands for the value of a marked column
_MARKS, _DIRECT, _ENTRIES = 0, 1, 2
_PACKED = ("rows", "sizes", "runs", "columns", "owners", "extras", "values")
_BLOB = "bucket int, kind int, " + ", ".join(f"{n} binary" for n in _PACKED)
_BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(n, pa.binary()) for n in _PACKED])
_NONE = np.zeros(0, np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), _BLOB_ARROW, strict=True)], schema=_BLOB_ARROW)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def n_tasks(entries: int) -> int:
    """Buckets, and blocks of rows, for so many entries."""
    return int(max(1, -(-entries // BUCKET_ENTRIES)))


# --- heavy columns -------------------------------------------------------------------
def heavy_candidates(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Columns that occur FREQUENT times or more in these entries, and how often."""
    columns = np.concatenate(parts) if parts else _NONE
    columns.sort()
    at = _runs(columns)
    counts = np.diff(np.append(at, len(columns)))
    often = counts >= FREQUENT
    return columns[at[often]], counts[often]


def heavy_columns(counted: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """The heavy columns, sorted, and their counts, from (column, n) of ``heavy_candidates``.

    Each has FREQUENT / FLUSH_ENTRIES of the entries at least, so the driver gets no more
    than FLUSH_ENTRIES / FREQUENT rows."""
    sums = counted.groupBy("column").agg(F.sum("n").alias("n")).where(F.col("n") * F.lit(FLUSH_ENTRIES) >= F.lit(FREQUENT * entries))
    table = sums.toArrow()
    columns, counts = np.asarray(table["column"]).view(np.uint64), np.asarray(table["n"])
    order = np.argsort(columns)
    return columns[order], counts[order]


# --- entries to buckets --------------------------------------------------------------
def _edges(sorted_columns: np.ndarray, n_buckets: int) -> np.ndarray:
    limits = np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_columns, limits), [len(sorted_columns)]])


def _direct(n_blocks: int, rows, sizes, owners, columns, extras, values) -> Iterator[tuple]:
    """Records of entries for the blocks of their rows; ``owners`` says whose an entry is."""
    block = (mix(rows.view(np.uint64)) % np.uint64(n_blocks)).astype(np.int32)
    order = np.lexsort((owners, block[owners]))
    owners, columns, values = owners[order], columns[order], values[order]
    extras = extras[order] if len(extras) else extras
    at = np.append(_runs(block[owners]), len(owners)).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        begin = _runs(owners[a:b])
        named = owners[a:b][begin]
        yield (
            int(block[named[0]]), _DIRECT, pack(rows[named].view(np.uint64), 8), pack(sizes[named], 4), pack(np.diff(np.append(begin, b - a)), 4),
            pack(columns[a:b], 8), b"", pack(extras[a:b], 8) if len(extras) else b"", pack(values[a:b].view(np.uint64), 8),
        )


def _send(n_buckets: int, read: Callable, heavy: tuple[np.ndarray, np.ndarray]) -> Callable:
    """``read(ids, nulls, offsets, data)`` yields (rows, sizes, entries per row, columns, extras)."""
    heavy_of, heavy_values = heavy

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, sizes, per_row, columns, extras = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        owners = np.repeat(np.arange(len(rows), dtype=np.uint32), per_row)
        if len(heavy_of):
            at = np.searchsorted(heavy_of, columns)
            at[at == len(heavy_of)] = 0
            known = heavy_of[at] == columns
            if known.any():
                yield from _batches(_direct(n_buckets, rows, sizes, owners[known], columns[known], extras[known] if len(extras) else extras, heavy_values[at[known]]))
                columns, owners, extras = columns[~known], owners[~known], extras[~known] if len(extras) else extras
            del at, known
        order = np.argsort(columns)
        columns, owners = columns[order], owners[order]
        extras = extras[order] if len(extras) else extras
        del order
        edges = _edges(columns, n_buckets)

        def records():
            for bucket, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if a < b:
                    named, place = np.unique(owners[a:b], return_inverse=True)  # the rows that come here
                    yield bucket, _ENTRIES, pack(rows[named].view(np.uint64), 8), pack(sizes[named], 4), b"", pack(columns[a:b], 8), pack(place, 4), pack(extras[a:b], 8) if len(extras) else b"", b""

        yield from _batches(records())

    def run(batches):
        forget()
        parts, held = [], 0
        for piece in slices(batches):
            for part in read(*piece):
                if len(part[3]):
                    parts.append(part)
                    held += len(part[3])
                if held >= FLUSH_ENTRIES:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)
        release()

    return run


def _send_marks(n_buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            columns = np.sort(np.asarray(batch.column(0)).view(np.uint64))
            edges = _edges(columns, n_buckets).tolist()
            out = [(k, _MARKS, b"", b"", b"", pack(columns[a:b], 8), b"", b"", b"") for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            if out:
                yield _batch(out)

    return run


# --- buckets to blocks ---------------------------------------------------------------
def _reply(n_blocks: int, value: str, each_entry: bool) -> Callable:
    def settle(columns, refs, rows, sizes, extras, marks) -> Iterator[pa.RecordBatch]:
        order = np.argsort(columns)
        columns, refs = columns[order], refs[order]
        extras = extras[order] if len(extras) else extras
        del order
        begin = _runs(columns)
        keep = np.diff(np.append(begin, len(columns))) > 1  # a column of one entry is no one else's
        if len(marks):
            at = np.searchsorted(marks, columns[begin])
            at[at == len(marks)] = 0
            keep |= marks[at] == columns[begin]
        keep = np.repeat(keep, np.diff(np.append(begin, len(columns))))
        columns, refs = columns[keep], refs[keep]
        extras = extras[keep] if len(extras) else extras
        if not len(columns):
            return
        owner = rows[refs]
        order = np.lexsort((owner, columns))
        columns, refs, owner = columns[order], refs[order], owner[order]
        extras = extras[order] if len(extras) else extras
        begin = _runs(columns)
        fresh = np.ones(len(columns), dtype=bool)
        fresh[1:] = (columns[1:] != columns[:-1]) | (owner[1:] != owner[:-1])
        count = np.add.reduceat(fresh.astype(np.int64), begin)
        what = np.minimum.reduceat(owner, begin) if value == "first" else count
        shared = count >= 2
        if len(marks):
            at = np.searchsorted(marks, columns[begin])
            at[at == len(marks)] = 0
            marked = marks[at] == columns[begin]
            shared |= marked
            what = np.where(marked, MARKED, what)
        lengths = np.diff(np.append(begin, len(columns)))
        keep = np.repeat(shared, lengths) & (fresh | each_entry)
        refs = refs[keep]
        named, place = np.unique(refs, return_inverse=True)
        yield from _batches(_direct(n_blocks, rows[named], sizes[named], place, columns[keep], extras[keep] if len(extras) else extras, np.repeat(what, lengths)[keep]))

    def bucket_answers(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        columns, refs, rows, sizes, extras, marks, n = [], [], [], [], [], [], 0
        for r in records:
            if r["kind"] == _DIRECT:  # of a heavy column, on its way to the row's block
                yield _batch([(r["bucket"], _DIRECT, *(bytes(r[k]) for k in _PACKED))])
                continue
            if r["kind"] == _MARKS:
                marks.append(unpack(r["columns"], 8))
                continue
            columns.append(unpack(r["columns"], 8))
            refs.append((unpack(r["owners"], 4) + np.uint64(n)).astype(np.uint32))
            rows.append(unpack(r["rows"], 8).view(np.int64))
            sizes.append(unpack(r["sizes"], 4).astype(np.int64))
            if r["extras"]:
                extras.append(unpack(r["extras"], 8))
            n += len(rows[-1])
        if not columns:
            return
        together = [np.concatenate(x) if x else _NONE for x in (columns, refs, rows, sizes, extras)]
        del columns, refs, rows, sizes, extras
        yield from settle(*together, np.unique(np.concatenate(marks)) if marks else _NONE)

    def run(batches):
        forget()
        yield from grouped(batches, "bucket", bucket_answers)
        release()

    return run


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Records in batches of some BATCH_BYTES."""
    out, held = [], 0
    for record in records:
        out.append(record)
        held += sum(map(len, record[2:]))
        if held >= BATCH_BYTES:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _finish(finish: Callable) -> Callable:
    def block(records):
        rows, sizes, runs, columns, extras, values = [], [], [], [], [], []
        for r in records:
            rows.append(unpack(r["rows"], 8).view(np.int64))
            sizes.append(unpack(r["sizes"], 4).astype(np.int64))
            runs.append(unpack(r["runs"], 4).astype(np.int64))
            columns.append(unpack(r["columns"], 8))
            values.append(unpack(r["values"], 8).view(np.int64))
            if r["extras"]:
                extras.append(unpack(r["extras"], 8))
        if not rows:
            return
        named, first, place = np.unique(np.concatenate(rows), return_index=True, return_inverse=True)
        owner = np.repeat(place.astype(np.uint32), np.concatenate(runs))
        order = np.argsort(owner, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(named)))])
        of_rows = np.concatenate(sizes)[first]
        del rows, sizes, runs, owner
        held = []
        for x in (columns, extras, values):
            held.append(np.concatenate(x)[order] if x else _NONE)
            x.clear()
        yield from finish(named, of_rows, begin, *held)

    def run(batches):
        yield from grouped(batches, "bucket", block)
        release()

    return run


def shared_columns(
    docs: DataFrame, entries: int, read: Callable, finish: Callable, schema: str, heavy: tuple[np.ndarray, np.ndarray],
    value: str = "count", each_entry: bool = False, marked: DataFrame | None = None,
) -> DataFrame:
    """Rows made by ``finish(rows, sizes, begin, columns, extras, values)`` from the entries
    of columns that two rows or more share, called once for each block of rows: entries
    ``begin[i]`` to ``begin[i + 1]`` are all those of row i.

    ``value`` is "count" (rows that hold the column) or "first" (the smallest row that
    holds it).  ``heavy`` has the heavy columns and the value that stands for each; rows
    that are read more than once bring an entry of such a column as often.  With
    ``each_entry`` all entries of a shared column that one row has are kept.  Columns in ``marked``
    (one column of longs) are always shared and have the value MARKED.
    """
    n = n_tasks(entries)
    sent = docs.mapInArrow(_send(n, read, heavy), _BLOB)
    if marked is not None:
        sent = sent.unionByName(marked.mapInArrow(_send_marks(n), _BLOB))
    sent = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    replies = sent.mapInArrow(_reply(n, value, each_entry), _BLOB)
    replies = replies.repartition(n, "bucket").sortWithinPartitions("bucket")
    return replies.mapInArrow(_finish(finish), schema)
