"""Operator 1: quality score by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics.  A class has a mean and a
covariance shrunk towards the pooled one and a multiple of the identity; the score is the
logistic of the difference of log densities, taken from Mahalanobis distances with the
Cholesky factors of both classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, slices, span_hashes, texts, word_spans

SHRINK_POOLED = 0.1
SHRINK_IDENTITY = 0.02
CUT_OFF = 0.3
FEATURES = (
    "log words", "log mean word length", "log spread of word length", "upper-case share", "symbol share", "exclamation share", "bar share",
    "digit share", "vocabulary growth", "share of repeated neighbours", "stops per word", "log lines", "share of other bytes", "byte entropy", "words with symbols",
)

# Classes of bytes: 0 other, 1 capital, 2 small letter, 3 digit, 4 blank, 5 stop or comma, 6 symbol.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 6
_CLASS[[44, 46, 58, 59, 63]] = 5


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, fold=False)
    at = np.searchsorted(starts, offsets)
    symbol = np.concatenate([[0], np.cumsum(_CLASS[data] == 6)])
    marked = symbol[ends] > symbol[starts]
    lengths = (ends - starts).astype(np.float64)
    out = np.zeros((n, len(FEATURES)))
    latin_capital = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        latin_capital[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    for i in range(n):
        a, b, p, q = offsets[i], offsets[i + 1], at[i], at[i + 1]
        if q <= p:
            continue
        byte = np.bincount(data[a:b], minlength=256)
        kind = np.bincount(_CLASS, weights=byte, minlength=7)
        size, words = float(b - a), float(q - p)
        upper = kind[1] + latin_capital[a:b].sum()
        letters = kind[1] + kind[2] + byte[0xC3]
        share = byte[byte > 0] / size
        own = hashes[p:q]
        out[i] = (
            np.log1p(words), np.log(lengths[p:q].mean()), np.log1p(lengths[p:q].std()), np.sqrt(upper / max(letters, 1)), np.sqrt(kind[6] / size),
            np.sqrt(byte[33] / size), np.sqrt(byte[124] / size), np.sqrt(kind[3] / size), np.log1p(len(np.unique(own))) / np.log1p(words),
            np.sqrt((own[1:] == own[:-1]).sum() / words), np.sqrt(kind[5] / words), np.log1p(byte[10]), np.sqrt(kind[0] / size), -(share * np.log2(share)).sum(), np.sqrt(marked[p:q].sum() / words),
        )
    return out


def _featurise(batches):
    for ids, nulls, offsets, data in slices(batches):
        x = statistics(data, offsets)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), values], names=["doc_id", "x"])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the transformed statistics of every whole text (all 0 without words)."""
    return texts(docs, id_col, text_col).mapInArrow(_featurise, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), len(FEATURES))


@dataclass
class QuadraticDiscriminant:
    """Means, log priors and inverse Cholesky factors of the two classes; without rows of
    one of them, ``constant`` is the score of everything."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = [o - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def _moments(batches):
    """Per class and batch: count, sums and sums of products, laid out flat."""
    d = len(FEATURES)
    for batch in batches:
        y, x = np.asarray(batch.column("y")), _matrix(batch.column("x"))
        for label in (0, 1):
            own = x[y == label]
            if len(own):
                flat = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[np.triu_indices(d)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), label, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["label", "k", "v"])


def fit(labelled: DataFrame, shrink_pooled: float = SHRINK_POOLED, shrink_identity: float = SHRINK_IDENTITY) -> QuadraticDiscriminant:
    """Fits on all rows of ``labelled`` (x, y): their moments are summed on the executors
    and some 140 numbers per class reach the driver, however many rows there are."""
    sums = labelled.select("x", F.col("y").cast("int").alias("y")).where("y in (0, 1)").mapInArrow(_moments, "label int, k int, v double")
    rows = sums.groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    d = len(FEATURES)
    flat = np.zeros((2, 1 + d + d * (d + 1) // 2))
    for r in rows:
        flat[r["label"], r["k"]] = r["v"]
    counts = flat[:, 0]
    if counts.min() == 0:
        return QuadraticDiscriminant(constant=float((counts[1] + 1) / (counts.sum() + 2)))
    means, spreads = flat[:, 1 : 1 + d] / counts[:, None], []
    for label in (0, 1):
        full = np.zeros((d, d))
        full[np.triu_indices(d)] = flat[label, 1 + d :]
        full = full + np.triu(full, 1).T
        spreads.append(full / counts[label] - np.outer(means[label], means[label]))
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / counts.sum()
    factors, offsets = [], []
    for label in (0, 1):
        c = (1 - shrink_pooled) * spreads[label] + shrink_pooled * pooled
        c = (1 - shrink_identity) * c + shrink_identity * np.eye(d) * max(np.trace(c) / d, 1e-6)
        chol = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(chol))
        offsets.append(np.log(counts[label] / counts.sum()) - np.log(np.diag(chol)).sum())
    return QuadraticDiscriminant(means, np.stack(factors), np.array(offsets))


def quality_scores(docs: DataFrame, train_labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_off: float = CUT_OFF) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``; ``train_labels`` has (doc_id, y).

    The statistics are computed once and kept in the checkpoint folder (15 numbers a
    row); only they meet the labels, texts are never shuffled.  Very long texts are read
    whole.  Null or empty text: the
    vector of zeros, scored like any other.  Null doc_id: scored, never trained on.
    Repeated rows: each is scored and trained on.  Labels that are null or neither 0 nor
    1 are not used.  With no labels of a class every score is the share of label 1
    (0.5 without labels).  Empty table: no rows.  Other columns are not read.
    """
    features = cut(document_features(docs, id_col, text_col))
    model = fit(features.join(train_labels.select(F.col("doc_id").cast("long").alias("doc_id"), "y"), "doc_id"))

    def score(batches):
        for batch in batches:
            s = model.scores(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= cut_off).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.mapInArrow(score, "doc_id long, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality_scores`` of all documents, learned from four fifths of the labels."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", F.col("quality").alias("y"))
    out = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
