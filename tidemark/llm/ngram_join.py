"""Operator 9: documents whose word n-gram sets have Jaccard similarity of 0.8 or more.

The join is the product of the document-by-shingle incidence matrix with its transpose,
taken in blocks and kept sparse by bounds that follow from set sizes:

* documents with equal sets are one row of the matrix;
* a column held by one row adds to no overlap and goes; a row that keeps fewer than
  ``ceil(0.8 n)`` shared columns can reach no partner and goes as well;
* of each remaining row only its rarest columns (so many that any partner must share
  one) name candidates, and candidates whose sizes exclude the bound are discarded;
* overlap counts are accumulated over all shared columns of the candidate rows.

Candidates are multiplied row of a pivot by rows of its column, see ``components``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, cut, release, set_digests, slices, text_key, text_sets, texts, without
from tidemark.llm.components import linked_components, overlap_links
from tidemark.llm.incidence import FLUSH_ENTRIES, heavy_candidates, heavy_columns, shared_columns

THRESHOLD = (4, 5)
_ROW = "node long, n long, cols binary, keys array<long>"
_ROW_ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("cols", pa.binary()), ("keys", pa.list_(pa.int64()))])
_NONE = np.zeros(0, np.uint64)


def _distinct(digests: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Mask of the first row of each digest among those that are ``real``."""
    at = np.flatnonzero(real)
    keep = np.zeros(len(digests), dtype=bool)
    keep[at[np.unique(digests[at], return_index=True)[1]]] = True
    return keep


def _measure(batches):
    """doc_id, text key, set size and set digest of each document; besides, shingles that are
    frequent in a block of entries, as (null, null, how often, shingle, true)."""
    names = ["doc_id", "key", "n_shingles", "node", "heavy"]

    def frequent(parts):
        columns, counts = heavy_candidates(parts)
        nothing = pa.nulls(len(columns), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, pa.array(counts, pa.int64()), pa.array(columns.view(np.int64)), pa.array(np.ones(len(columns), bool))], names=names)

    parts, held = [], 0
    for ids, nulls, offsets, data in slices(batches):
        flat, sizes = text_sets(data, offsets)
        digests = set_digests(flat, sizes).view(np.int64)
        keep = _distinct(digests, (sizes > 0) & ~nulls)
        parts.append(flat[np.repeat(keep, sizes)])
        held += len(parts[-1])
        raw = memoryview(data)
        # Spark's xxhash64 of the text: the same digest with this seed.
        keys = [xxhash.xxh64_intdigest(raw[a:b], seed=42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes, type=pa.int64()), pa.array(digests, mask=sizes == 0), pa.array(np.zeros(len(ids), bool))], names=names)
        if held >= FLUSH_ENTRIES:
            yield frequent(parts)
            parts, held = [], 0
    if held:
        yield frequent(parts)
    release()


def _read(ids, nulls, offsets, data):
    flat, sizes = text_sets(data, offsets)
    digests = set_digests(flat, sizes).view(np.int64)
    keep = _distinct(digests, (sizes > 0) & ~nulls)
    yield digests[keep], sizes[keep], sizes[keep], flat[np.repeat(keep, sizes)], _NONE


def _survivors(num: int, den: int):
    def finish(rows, sizes, begin, columns, extras, values):
        need = -(-num * sizes // den)
        out = []
        for i in np.flatnonzero(np.diff(begin) >= need).tolist():
            own, held = columns[begin[i] : begin[i + 1]], values[begin[i] : begin[i + 1]]
            order = np.lexsort((own, held))
            own = own[order]
            # Equal documents of several tasks bring the entries of heavy columns once each.
            fresh = np.ones(len(own), dtype=bool)
            fresh[1:] = own[1:] != own[:-1]
            own = own[fresh]
            # A partner holds ``need`` of the n columns, so it shares one of the n - need + 1
            # rarest; those that nobody shares are the rarest of all.
            p = int(len(own) - need[i] + 1)
            if p > 0:
                out.append((int(rows[i]), int(sizes[i]), np.sort(own).astype("<u8").tobytes(), own[:p].astype(np.int64)))
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return finish


def _rows(out):
    node, n, cols, keys = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(cols, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], schema=_ROW_ARROW)


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles five words; a text
    of one to four words has its whole sequence as one shingle.  Two documents link when
    ``intersection / union >= threshold`` (a fraction of two integers, compared exactly).
    component_id is the smallest doc_id reachable by links, the document itself included.

    Null or empty text, or one of white space only: n_shingles 0, linked with nothing.
    Null doc_id: the row stays, its component_id is null, and it links nothing.  A
    doc_id that occurs again, with the same or another text: every row is returned and
    is placed by its own text.  Very long texts are read whole.  Empty table: no rows.  Other columns are not read.
    """
    return _classes(docs, id_col, text_col, threshold).drop("key", "class")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int]) -> DataFrame:
    """As above, with the ``text_key`` of each row and the number of its class."""
    num, den = threshold
    source = texts(docs, id_col, text_col)
    read = cut(source.mapInArrow(_measure, "doc_id long, key long, n_shingles long, node long, heavy boolean"))
    measured = read.where("not heavy").drop("heavy")
    total = measured.agg(F.sum("n_shingles")).first()[0] or 0
    heavy = heavy_columns(read.where("heavy").select(F.col("node").alias("column"), F.col("n_shingles").alias("n")), total)
    rows = cut(shared_columns(source, total, _read, _survivors(num, den), _ROW, heavy))
    keys = rows.select(F.explode("keys").alias("key"), "node", "n")
    held = rows.select("node", "n", "cols")

    def verify(pairs: DataFrame, tasks: int) -> DataFrame:
        both = pairs.join(held.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("cols").alias("cols_b")), "b").coalesce(tasks)
        both = both.join(held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("cols").alias("cols_a")), "a")
        return both.select("a", "b", "n_a", "n_b", "cols_a", "cols_b").mapInArrow(overlap_links(num, den), "a long, b long")

    labels = linked_components(held, keys, verify, num, den)
    # The smallest document of each set, of each class of sets, and of each set's class.
    per_node = measured.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    linked = labels.join(per_node, "node")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    linked = linked.join(broadcast_if_small(lowest), "root").select("node", "root", "lowest")
    classes = per_node.join(linked, "node", "left").where("n > 1 or lowest is not null").select("node", "root", F.coalesce("lowest", "low").alias("lowest"))
    return measured.join(broadcast_if_small(classes), "node", "left").select(
        "doc_id", "key", "n_shingles", F.coalesce("root", "node").alias("class"), F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id")).alias("component_id")
    )


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) with one row of each class of near duplicates: the one with the
    smallest id, and of rows that share this id the text with the smallest hash, once.

    Rows without words are classes of their own and stay; so do rows with a null id.
    Repeated rows count as copies: one stays, unless they have no words.  Empty table: no
    rows.  Very long texts are compared whole.
    """
    classes = cut(_classes(docs, id_col, text_col, threshold).where("doc_id is not null and n_shingles > 0"))
    rows = classes.groupBy("doc_id", "key", "class", "component_id").agg(F.sum(F.lit(1)).alias("n"))
    lowest = rows.where("doc_id = component_id").groupBy(F.col("class").alias("__class")).agg(F.min("key").alias("__first"), F.sum("n").alias("rows"))
    # Ids that occur again are few; only they need more than a comparison with the class.
    again = broadcast_if_small(lowest.where("rows > 1").drop("rows"))
    rows = rows.join(again, F.col("class") == F.col("__class"), "left")
    out = without(docs, rows.where((F.col("doc_id") != F.col("component_id")) | (F.col("key") > F.col("__first"))).select("doc_id", "key"), id_col, text_col)
    twice = broadcast_if_small(rows.where("doc_id = component_id and key = __first and n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__first")))
    if twice.isEmpty():
        return out
    marked = out.join(twice, (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & (text_key(F.col(f"`{text_col}`")) == F.col("__first")), "left")
    once = marked.where("__id is not null").dropDuplicates(["__id", "__first"])
    return marked.where("__id is null").unionByName(once).drop("__id", "__first")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ngram_jaccard_components`` of all documents."""
    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
