"""Operator 3: passages that repeat across a corpus, by MinHash banding of paragraphs.

Two kinds of paragraph are compared, each with its own kind:

* "paragraph": a line of 25 words or more;
* "passage": 32 words in a row, whatever lines they stand on.  Of 19 neighbouring places
  where one could begin, the one whose first shingle has the least hash is taken
  (winnowing), so that any 50 words in a row that two documents share hold one such window
  that is the same in both.  Windows are compared only if they begin with the same shingle:
  one window and the next, moved by a few words, would otherwise be near copies too.

A paragraph is the set of its five-word shingles.  MinHash bands, tuned to a recall, bring
paragraphs together; the exact Jaccard similarity of their sets decides; connected
components are the classes, and each class keeps the paragraph that stands first in the
document with the smallest number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SHINGLE_WORDS, _splitmix, broadcast_if_small, cut, mix, release, rolling_hashes, set_digests, slices, sorted_sets, span_hashes, texts, word_spans
from tidemark.llm.components import linked_components, overlap_links, packed_sets
from tidemark.llm.incidence import FLUSH_ENTRIES, MARKED, _runs, heavy_candidates, heavy_columns, shared_columns

THRESHOLD = (4, 5)
MIN_WORDS = 25
WINDOW = 32  # words of a passage
WINNOW = 19  # a run of WINDOW + WINNOW - 1 words that two texts share has a window in both
RECALL, MAX_HASHES = 0.99, 24  # of lines
WINDOW_RECALL, WINDOW_HASHES = 0.95, 6  # of windows; equal ones always meet
WINDOW_BLOCK = 1 << 14
SET_BYTES = 6  # of each shingle hash that the sets of two candidates are compared by
SIEVE_BITS = 25  # a bitmap of 4 MB
LINE, PASSAGE = 0, 1
_NONE = np.zeros(0, np.uint64)


def tune_bands(similarity: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest false candidates, with which
    a pair at ``similarity`` collides with probability ``recall`` within ``max_hashes``."""
    best = None
    for rows in range(1, 17):
        miss = 1 - similarity**rows
        bands = ceil(log(1 - recall) / log(miss)) if miss > 0 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


@dataclass
class Paragraphs:
    """Paragraphs of one kind: the text of each, its place there (number of the line, or of
    the first word), its words, the shingle that a window begins with (0 for lines), and its
    set: hashes laid end to end and how many."""

    kind: int
    owner: np.ndarray
    place: np.ndarray
    words: np.ndarray
    anchor: np.ndarray
    flat: np.ndarray
    sizes: np.ndarray

    def nodes(self) -> np.ndarray:
        """What names kind, first shingle and set."""
        return mix(set_digests(self.flat, self.sizes, self.kind + 1) ^ mix(self.anchor)).view(np.int64)

    def pick(self, keep: np.ndarray) -> Paragraphs:
        return Paragraphs(self.kind, self.owner[keep], self.place[keep], self.words[keep], self.anchor[keep], self.flat[np.repeat(keep, self.sizes)], self.sizes[keep])


def _winnowed(rolled: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """First words of the winnowed windows: places whose shingle is the least of WINNOW
    neighbouring places of a text (of all, in a text with fewer)."""
    n = len(doc) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    inside = doc[:n] == doc[WINDOW - 1 :]
    value = np.where(inside, rolled[:n], top)
    first = _runs(doc[:n])
    least = np.minimum.reduceat(value, first)
    few = np.add.reduceat(inside.astype(np.int64), first) < WINNOW
    lengths = np.diff(np.append(first, n))
    taken = np.repeat(few, lengths) & (value == np.repeat(least, lengths))
    m = n - WINNOW + 1
    if m > 0:
        low = np.lib.stride_tricks.sliding_window_view(value, WINNOW).min(axis=1)
        low = np.where(inside[WINNOW - 1 :] & (doc[:m] == doc[WINNOW - 1 : n]), low, np.uint64(0))
        padded = np.concatenate([np.zeros(WINNOW - 1, np.uint64), low, np.zeros(WINNOW - 1, np.uint64)])
        taken |= value == np.lib.stride_tricks.sliding_window_view(padded, WINNOW).max(axis=1)
    return np.flatnonzero(taken & inside)


def _thinned(at: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask without windows that repeat the one before them: of a run of equal ones the
    first, the last and one in each half window stay, which cover the same words."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    change = np.ones(len(at), dtype=bool)
    change[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
    begin = at[change][np.cumsum(change) - 1]
    step = (at - begin) // (WINDOW // 2)
    keep = change.copy()
    keep[1:] |= step[1:] != step[:-1]
    keep[:-1] |= change[1:]
    keep[-1] = True
    return keep


def paragraphs(data: np.ndarray, offsets: np.ndarray, min_words: int) -> Iterator[Paragraphs]:
    """The paragraphs of texts laid end to end: lines first, then blocks of windows."""
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return
    words = span_hashes(data, starts, ends)
    rolled = rolling_hashes(words)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    line = np.ones(len(starts), dtype=bool)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, starts)
    line[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    del starts, ends, number
    first_word = np.searchsorted(doc, np.arange(len(offsets) - 1))
    begin = np.flatnonzero(line)
    length = np.diff(np.append(begin, len(doc)))
    owner = doc[begin]
    place = np.arange(len(begin)) - np.searchsorted(owner, owner)
    long = length >= max(min_words, SHINGLE_WORDS)
    begin, length, owner, place = begin[long], length[long], owner[long], place[long]
    counts = length - SHINGLE_WORDS + 1
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    yield Paragraphs(LINE, owner, place, length, np.zeros(len(length), np.uint64), *sorted_sets(rolled[at], counts))
    del at
    begin = _winnowed(rolled, doc)
    k = WINDOW - SHINGLE_WORDS + 1
    for a in range(0, len(begin), WINDOW_BLOCK):
        own = begin[a : a + WINDOW_BLOCK]
        sets = np.sort(rolled[own[:, None] + np.arange(k)[None, :]], axis=1)
        fresh = np.ones(sets.shape, dtype=bool)
        fresh[:, 1:] = sets[:, 1:] != sets[:, :-1]
        found = Paragraphs(PASSAGE, doc[own], own - first_word[doc[own]], np.full(len(own), WINDOW), rolled[own], sets[fresh], fresh.sum(axis=1))
        yield found.pick(_thinned(own, found.nodes(), found.owner))


def _band_keys(p: Paragraphs, bands: int, rows: int) -> np.ndarray:
    """Keys (paragraph by band) of the MinHash signatures of non-empty sets."""
    flat, sizes = p.flat, p.sizes
    at = np.cumsum(sizes) - sizes
    seeds = _splitmix(2 * bands * rows, 0xA5A5)
    keys = np.zeros((len(sizes), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            total = p.anchor + np.uint64(2 * band + 1 + p.kind)
            for r in range(rows):
                k = 2 * (band * rows + r)
                low = np.minimum.reduceat((flat ^ seeds[k]) * (seeds[k + 1] | np.uint64(1)), at)
                total = mix(total * np.uint64(0x9E3779B97F4A7C15) + low)
            keys[:, band] = total
    return keys


def _bands_of(p: Paragraphs, nodes: np.ndarray, bands: dict[int, tuple[int, int]]):
    """The distinct sets among these paragraphs as rows, their bands as columns."""
    keep = np.zeros(len(nodes), dtype=bool)
    keep[np.unique(nodes, return_index=True)[1]] = True
    p, nodes = p.pick(keep), nodes[keep]
    return nodes, p.sizes, np.full(len(nodes), bands[p.kind][0]), _band_keys(p, *bands[p.kind]).reshape(-1), _NONE


def _banded(bands: dict[int, tuple[int, int]], min_words: int):
    """Rows are distinct sets of paragraphs, columns their bands."""

    def read(ids, nulls, offsets, data):
        for p in paragraphs(data, offsets, min_words):
            p = p.pick(~nulls[p.owner])
            if len(p.owner):
                yield _bands_of(p, p.nodes(), bands)

    return read


_PLACE = np.uint64(32)
_KIND = np.uint64(63)


def _placed(min_words: int):
    """Rows are documents, columns the names of their paragraphs, extras where these stand."""

    def read(ids, nulls, offsets, data):
        columns, owners, extras = [], [], []
        for p in paragraphs(data, offsets, min_words):
            keep = ~nulls[p.owner]
            columns.append(p.nodes()[keep].view(np.uint64))
            owners.append(p.owner[keep])
            extras.append((np.uint64(p.kind) << _KIND | p.place.astype(np.uint64) << _PLACE | p.words.astype(np.uint64))[keep])
        if columns:
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            yield ids, np.zeros(len(ids), np.int64), np.bincount(owner, minlength=len(ids)), np.concatenate(columns)[order], np.concatenate(extras)[order]

    return read


def _measure(bands: dict[int, tuple[int, int]], min_words: int):
    """(which, column, n): entries of both incidences in all (column null), and the columns
    that are frequent in a block of entries."""
    def run(batches):
        total, held, parts = [0, 0], [0, 0], [[], []]

        def frequent(which):
            columns, counts = heavy_candidates(parts[which])
            parts[which], held[which] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns), which, np.int32)), pa.array(columns.view(np.int64)), pa.array(counts, pa.int64())], names=["which", "column", "n"])

        for piece in slices(batches):
            _, nulls, offsets, data = piece
            for p in paragraphs(data, offsets, min_words):
                p = p.pick(~nulls[p.owner])
                if not len(p.owner):
                    continue
                nodes = p.nodes()
                for which, columns in enumerate((_bands_of(p, nodes, bands)[3], nodes.view(np.uint64))):
                    parts[which].append(columns)
                    held[which] += len(columns)
                    total[which] += len(columns)
                    if held[which] >= FLUSH_ENTRIES:
                        yield frequent(which)
        for which in range(2):
            yield frequent(which)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.nulls(2, pa.int64()), pa.array(total, pa.int64())], names=["which", "column", "n"])
        release()

    return run


def _candidates(rows, sizes, begin, columns, extras, values):
    lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(columns.view(np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sizes), lists], names=["node", "n", "keys"])


def _sieve(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of each node set; driver and tasks hold 4 MB of it
    however many nodes there are, and the join that follows it drops what it lets through."""
    place = f"shiftrightunsigned(node, {64 - SIEVE_BITS})"
    words = nodes.select(F.expr(f"shiftright({place}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^(SIEVE_BITS - 6) rows at most
    out = np.zeros(1 << (SIEVE_BITS - 6), dtype=np.uint64)
    out[np.asarray(table["word"])] = np.asarray(table["bits"]).view(np.uint64)
    return out


def _sets(sieve, min_words: int):
    """node, n, cols of each paragraph that the bitmap lets through."""

    def run(batches):
        bits = sieve.value
        for _, _, offsets, data in slices(batches):
            for p in paragraphs(data, offsets, min_words):
                nodes = p.nodes()
                place = nodes.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
                keep = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                keep[keep] = np.isin(np.flatnonzero(keep), np.flatnonzero(keep)[np.unique(nodes[keep], return_index=True)[1]])
                p, nodes = p.pick(keep), nodes[keep]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(p.sizes, pa.int64()), packed_sets(p.flat, p.sizes, SET_BYTES)], names=["node", "n", "cols"])
        release()

    return run


_FOUND = "doc_id long, kind int, first long, last long, n_words long, component_id long, kept boolean, node long"


def _repeats(rows, sizes, begin, columns, extras, values):
    """Places of shared paragraphs.  A marked one keeps its node, for its class to be found;
    of the others the class is the node itself: equal sets, kept at the first place of the
    smallest document.  Windows that meet or overlap and share a holder are one passage."""
    doc = np.repeat(np.arange(len(rows)), np.diff(begin))
    kind = (extras >> _KIND).astype(np.int64)
    place = ((extras >> _PLACE) & np.uint64(0x7FFFFFFF)).astype(np.int64)
    words = (extras & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((place, columns, doc))
    fresh = np.ones(len(order), dtype=bool)
    same = (doc[order][1:] == doc[order][:-1]) & (columns[order][1:] == columns[order][:-1])
    fresh[1:] = ~same
    again = np.ones(len(order), dtype=bool)  # not a second reading of one place, from a repeated row
    again[1:] = ~(same & (place[order][1:] == place[order][:-1]))
    first = np.zeros(len(order), dtype=bool)
    first[order[fresh]] = True
    real = np.zeros(len(order), dtype=bool)
    real[order[again]] = True
    marked = values == MARKED
    kept = ~marked & first & (values == rows[doc])
    holder = np.where(marked, 0, values)

    def batch(of, start, stop, n_words, node):
        null = pa.nulls(len(of), pa.int64())
        known = [null, pa.nulls(len(of), pa.bool_())] if node else [pa.array(holder[of]), pa.array(kept[of])]
        cols = [pa.array(rows[doc[of]]), pa.array(kind[of].astype(np.int32)), pa.array(start), pa.array(stop), pa.array(n_words), *known, pa.array(columns[of].view(np.int64)) if node else null]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "kind", "first", "last", "n_words", "component_id", "kept", "node"])

    last = np.where(kind == PASSAGE, place + words - 1, place)
    at = np.flatnonzero(marked & real)
    yield batch(at, place[at], last[at], words[at], True)
    at = np.flatnonzero(~marked & real & (kind == LINE))
    yield batch(at, place[at], last[at], words[at], False)
    at = np.flatnonzero(~marked & real & (kind == PASSAGE))
    at = at[np.lexsort((place[at], holder[at], kept[at], doc[at]))]
    if len(at):
        new = np.ones(len(at), dtype=bool)
        new[1:] = (doc[at][1:] != doc[at][:-1]) | (kept[at][1:] != kept[at][:-1]) | (holder[at][1:] != holder[at][:-1]) | (place[at][1:] > last[at][:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        yield batch(at[head], place[at[head]], last[at[tail]], last[at[tail]] - place[at[head]] + 1, False)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kind, first, last, n_words, component_id, kept: every paragraph of a document
    that another document holds too, equal or with similarity ``threshold`` or more.

    kind "paragraph": a line of ``min_words`` or more; first = last = its number among the
    document's lines that have words, from 0.  kind "passage": windows of WINDOW words that
    meet or overlap, as one row; first and last number the words of the document, from 0.
    Any 50 words in a row that two documents share (case of A-Z aside) are found; the ends
    of a passage may be up to WINNOW - 1 words short.  Rows may overlap.

    component_id is the document that keeps the class: the smallest doc_id that holds one
    of its paragraphs.  kept is true there, at the first place.  Every word of a row that is
    not kept stands in a paragraph of the same class that comes earlier, in an earlier
    document or earlier in the same one, so what is equal never loses all its copies; words
    in which near copies differ stay in the kept one only.

    Null or empty texts, texts and lines of fewer words and null doc_ids have no rows.  Very
    long texts are read whole, windows block by block.  Rows with the same doc_id are one
    document, and what repeats in one document only is not reported.  An empty table gives
    no rows.  Other columns are not read.
    """
    num, den = threshold
    bands = {LINE: tune_bands(num / den), PASSAGE: tune_bands(num / den, WINDOW_RECALL, WINDOW_HASHES)}
    source = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    measured = cut(source.mapInArrow(_measure(bands, min_words), "which int, column long, n long"))
    entries = {r["which"]: r["n"] for r in measured.where("column is null").groupBy("which").agg(F.sum("n").alias("n")).collect()}  # two rows
    heavy = [heavy_columns(measured.where((F.col("which") == k) & F.col("column").isNotNull()).select("column", "n"), entries.get(k, 0)) for k in (0, 1)]

    # Paragraphs that share a band with another one, their sets, and their classes.
    candidates = cut(shared_columns(source, entries.get(0, 0), _banded(bands, min_words), _candidates, "node long, n long, keys array<long>", heavy[0]))
    named = candidates.select("node")
    sieve = spark.sparkContext.broadcast(_sieve(named))
    sets = source.mapInArrow(_sets(sieve, min_words), "node long, n long, cols binary").join(named, "node", "left_semi")
    sets = cut(sets.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("cols").alias("cols")))

    def verify(pairs: DataFrame, tasks: int) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("cols").alias("cols_b")), "b").coalesce(tasks)
        both = both.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("cols").alias("cols_a")), "a")
        return both.select("a", "b", "n_a", "n_b", "cols_a", "cols_b").mapInArrow(overlap_links(num, den, SET_BYTES), "a long, b long")

    labels = cut(linked_components(sets, candidates.select(F.explode(F.array_distinct("keys")).alias("key"), "node", "n"), verify, num, den, SET_BYTES))

    # Places of paragraphs that are equal to others, or in one class with others.
    marked_value = (heavy[1][0], np.full(len(heavy[1][0]), MARKED))
    found = cut(shared_columns(source, entries.get(1, 0), _placed(min_words), _repeats, _FOUND, marked_value, value="first", each_entry=True, marked=labels.select("node")))
    open_ = found.where("node is not null").join(labels, "node", "left").withColumn("class", F.coalesce("root", "node"))
    classes = open_.groupBy("class").agg(F.min(F.struct("doc_id", "first")).alias("one"), F.max("doc_id").alias("top")).where("one.doc_id < top")
    settled = open_.join(broadcast_if_small(classes), "class").select(
        "doc_id", "kind", "first", "last", "n_words", F.col("one.doc_id").alias("component_id"),
        ((F.col("doc_id") == F.col("one.doc_id")) & (F.col("first") == F.col("one.first"))).alias("kept"),
    )
    out = found.where("node is null").drop("node").unionByName(settled)
    return out.withColumn("kind", F.when(F.col("kind") == LINE, "paragraph").otherwise("passage"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_passages`` of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
