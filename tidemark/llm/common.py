"""Shared pieces: lineage cuts, Arrow text access, hashing of words and shingles."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
_U64 = np.uint64


# --- lineage -------------------------------------------------------------------------
def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names.  Where none is named, one of our own in
    local mode, as in tests; on a cluster executors could not see it, so that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses
    nothing, and continue from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a few integers a row), materialised; marked for a broadcast if it is counted
    at ``limit`` rows or fewer, else left to a shuffled join, which adaptive execution
    splits at a hot key."""
    df = cut(df)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_key(text: Column) -> Column:
    """What stands for the text of a row beside its id: ids may occur again."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, leaving: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose id and ``text_key`` are in ``leaving`` (id, key): up
    to ``limit`` rows, counted first, are broadcast (16 bytes each), more are joined.  A
    null id leaves if it is listed."""
    leaving = cut(leaving.select(leaving[0].alias("__leaving_id"), leaving[1].alias("__leaving_key")).distinct())
    small = leaving.limit(limit + 1).count() <= limit
    hit = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__leaving_id")) & (text_key(F.col(f"`{text_col}`")) == F.col("__leaving_key"))
    return docs.join(F.broadcast(leaving) if small else leaving, hit, "left_anti")


# --- documents -----------------------------------------------------------------------
ARROW_BYTES = "8m"
_ARROW, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """A lower limit for the bytes of a batch on its way to a Python worker than Spark's
    default, unless the session has one of its own: JVM and worker hold a batch at once,
    and twice while it grows."""
    if spark.conf.get(_ARROW, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW, ARROW_BYTES)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty."""
    bound_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut Arrow batches of (doc_id, text) into runs of about ``max_bytes`` of text.

    Yields (ids, null mask of ids, offsets, bytes) with the UTF-8 bytes of the run as one
    array: text i is ``data[offsets[i]:offsets[i + 1]]``.  One text larger than
    ``max_bytes`` makes a run of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        null = np.asarray(ids.is_null())
        id_values = np.asarray(ids.fill_null(0), dtype=np.int64)
        text = batch.column(1)
        if pa.types.is_string(text.type):
            text = text.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        buffer = text.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(id_values):
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), len(id_values))
            yield id_values[start:stop], null[start:stop], offsets[start : stop + 1] - offsets[start], data[offsets[start] : offsets[stop]]
            start = stop


# --- hashing -------------------------------------------------------------------------
# The increment and the two multipliers of SplitMix64.
def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) + _U64(seed)
        z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
        return z ^ (z >> _U64(31))


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every output bit depends on every input bit, none is lost)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
        return z ^ (z >> _U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U64)  # the low k bytes
LONG_SPAN = 64
_SPANS = 1 << 18


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts; no word spans two."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    begins = space[:-1] & ~space[1:]
    ends = ~space[:-1] & space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):  # a text that ends in a word beside one that begins with a word
        both = ~space[inner] & ~space[inner + 1]
        begins[inner[both]] = True
        ends[inner[both]] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def span_lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lane: int) -> np.ndarray:
    """Bytes ``8 * lane`` and on of each span as one integer, bytes beyond the span as zero;
    ``data`` has eight bytes more than the last span needs."""
    eights = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    return eights[starts + 8 * lane] & _LANE[np.minimum(sizes - 8 * lane, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes, A-Z as a-z when ``fold``.

    The length and then eight bytes at a time are mixed in, so two spans of one length up
    to eight bytes never agree; spans over LONG_SPAN bytes take XXH3.  ``starts`` ascend.
    """
    out = np.empty(len(starts), dtype=_U64)
    for a in range(0, len(starts), _SPANS):
        begin = starts[a : a + _SPANS]
        sizes = ends[a : a + _SPANS] - begin
        base, stop = int(begin[0]), int(begin[-1] + sizes[-1])
        part = np.zeros(stop - base + 8, dtype=np.uint8)
        part[:-8] = _LOWER[data[base:stop]] if fold else data[base:stop]
        begin = begin - base
        with np.errstate(over="ignore"):
            h = mix(sizes.astype(_U64) * _U64(0x9E3779B97F4A7C15))
        h = mix(h ^ span_lanes(part, begin, sizes, 0))
        rest = np.flatnonzero((sizes > 8) & (sizes <= LONG_SPAN))
        lane = 1
        while len(rest):
            h[rest] = mix(h[rest] ^ span_lanes(part, begin[rest], sizes[rest], lane))
            lane += 1
            rest = rest[sizes[rest] > 8 * lane]
        raw = memoryview(part)
        for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[int(begin[i]) : int(begin[i] + sizes[i])])
        out[a : a + _SPANS] = h
    return out


_POSITION = _splitmix(SHINGLE_WORDS + 1, 0x6A09E667F3BCC909) | _U64(1)


def rolling_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of the k words from each place on (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, _U64)
    with np.errstate(over="ignore"):
        total = np.full(n, _U64(k) * _POSITION[k])
        for j in range(k):
            part = words[j : j + n] * _POSITION[j]
            total += part ^ (part >> _U64(31))
        return mix(total)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts laid end to end, and how many each text has.

    A text with fewer than k words has its whole sequence as one shingle, one without
    words has none.  Repeated shingles stay.
    """
    n_out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    firsts = np.cumsum(counts) - counts
    rolled = rolling_hashes(np.concatenate([words, np.zeros(k - 1, _U64)]), k)
    inside = np.ones(len(words), dtype=bool)
    # The last k - 1 places of a text begin no shingle of its own.
    for j in range(1, k):
        tail = (firsts + counts - j)[counts >= j]
        inside[tail] = False
    short = np.flatnonzero((counts > 0) & (counts < k))
    inside[firsts[short]] = True
    for i, a, n in zip(short.tolist(), firsts[short].tolist(), counts[short].tolist(), strict=True):
        rolled[a] = rolling_hashes(words[a : a + n], n)[0]
    return rolled[inside], n_out


def sorted_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted with repeats gone; the flat result and the set sizes."""
    hashes = hashes.copy()
    stops = np.cumsum(counts)
    for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    if not len(hashes):
        return hashes, counts
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[(stops - counts)[counts > 0]] = True
    sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(stops - counts, len(keep)))
    return hashes[keep], np.where(counts > 0, sizes, 0)


def text_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the set sizes."""
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    return sorted_sets(*shingle_hashes(words, counts))


def set_digests(flat: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit digest of each set (0 for an empty one): the sum of its members, mixed anew."""
    out = np.zeros(len(sizes), dtype=_U64)
    real = np.flatnonzero(sizes)
    if len(real):
        with np.errstate(over="ignore"):
            at = (np.cumsum(sizes) - sizes)[real]
            total = np.add.reduceat(mix(flat ^ _U64(0xD6E8FEB86659FD93)), at)
            out[real] = mix(total + sizes[real].astype(_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """Integers as ``width`` byte planes, low plane first: sorted values compress well so."""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(width, -1)
    raw = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    raw[:, :width] = planes.T
    return raw.reshape(-1).view("<u8")


def release() -> None:
    """Gives freed memory of this Python worker back to the system; workers are reused, and
    what one task held would otherwise count against the executor in all later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


#: What operators keep in a Python worker from one task to the next (an encoder, an automaton).
KEPT: list[dict] = []


def kept() -> dict:
    KEPT.append({})
    return KEPT[-1]


def forget() -> None:
    """Drops what other operators keep in this worker, before a task that needs memory."""
    for cache in KEPT:
        cache.clear()
    release()


def grouped(batches, key: str, handle: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Feeds ``handle`` the records of each run of equal keys, one at a time."""
    stream = (dict(zip(b.schema.names, row, strict=True)) for b in batches for row in zip(*(c.to_pylist() if not pa.types.is_binary(c.type) else (v.as_buffer() for v in c) for c in b.columns), strict=True))
    ahead = next(stream, None)
    while ahead is not None:
        current = ahead[key]

        def group():
            nonlocal ahead
            while ahead is not None and ahead[key] == current:
                record, ahead = ahead, next(stream, None)
                yield record

        records = group()
        yield from handle(records)
        for _ in records:
            pass
