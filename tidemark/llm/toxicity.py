"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has a logistic score over its words, a
document is toxic if any sentence is: the noisy-or of the sentence scores.  Weights are
learned from document labels alone; the sentence scores then say where the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, cut, release, texts

CUT_OFF = 0.7
SAMPLE_PER_CLASS = 2000
MIN_DOCS = 5
SCREEN = 3.0
STEPS = 300
STEMS = range(3, 8)
CACHE_WORDS = 200_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def word_features(word: str) -> list[str]:
    """The word itself and its stems, marked with a hyphen: inflected forms of a word that
    was rare in training share its stems."""
    return [word] + [word[:k] + "-" for k in STEMS if k <= len(word)]


class _Weights(dict):
    """Word -> summed weight of its features, or None; remembers a bounded number."""

    def __init__(self, weights: dict[str, float]):
        self.of = weights

    def __missing__(self, word: str) -> float | None:
        found = [self.of[f] for f in word_features(word) if f in self.of]
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = total = sum(found) if found else None
        return total


@dataclass
class NoisyOr:
    """Feature weights and the bias of a sentence's logistic score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self) -> Callable[[str], tuple[float, list[tuple[int, int, float]]]]:
        """text -> score of the document, and (start, end, score) of each sentence that has
        a weighted word."""
        of, quiet, bias = _Weights(self.weights), log1p(exp(self.bias)), self.bias

        def score(text: str):
            log_none, scored = 0.0, []
            for m in _SENTENCE.finditer(text):
                found = [w for w in map(of.__getitem__, {*_WORD.findall(m.group().lower())}) if w is not None]
                if not found:
                    log_none -= quiet
                    continue
                z = max(min(bias + sum(found), 30.0), -30.0)
                log_none -= log1p(exp(z))
                scored.append((m.start(), m.end(), 1 / (1 + exp(-z))))
            return 1 - exp(log_none), scored

        return score


@dataclass
class Bags:
    """What training sees of the labelled documents: the screened features; distinct bags
    of them (one per sentence, empty ones too) with how often a document has each."""

    labels: np.ndarray
    features: list[str]
    doc: np.ndarray  # of each bag
    times: np.ndarray  # of each bag
    bag: np.ndarray  # of each entry
    feature: np.ndarray  # of each entry


def fit(bags: Bags, steps: int = STEPS, lasso: float = 1e-4, rate: float = 4.0) -> NoisyOr:
    """Weights that maximise the class-balanced likelihood of the document labels under
    the noisy-or, by accelerated proximal gradient with a lasso penalty.  Steps are the
    same for all features, so one that few documents hold moves little.  Without both
    labels everything scores about 0.
    """
    labels, doc, times, bag, feature = bags.labels, bags.doc, bags.times, bags.bag, bags.feature
    if not len(labels) or labels.min() == labels.max():
        return NoisyOr()
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (labels == 0).sum())
    w, b = np.zeros(len(bags.features)), -5.0
    w_old, b_old = w, b
    for step in range(steps):
        push = step / (step + 3)
        v, c = w + push * (w - w_old), b + push * (b - b_old)
        z = np.clip(c + np.bincount(bag, weights=v[feature], minlength=len(doc)), -30, 30)
        none = np.exp(np.bincount(doc, weights=-times * np.logaddexp(0, z), minlength=len(labels)))
        pull = np.where(labels == 1, -none / np.maximum(1 - none, 1e-3), 1.0) * share
        slope = times * pull[doc] / (1 + np.exp(-z))
        w_old, b_old = w, b
        w = v - rate * np.bincount(feature, weights=slope[bag], minlength=len(w))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        b = c - rate * slope.sum() / 10
    return NoisyOr({f: float(x) for f, x in zip(bags.features, w, strict=True) if abs(x) >= 0.02}, float(b))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, y): at most ``per_class`` labelled documents of each label, those with the
    smallest hash of their id, whole; of an id with several texts the one with the smallest
    hash.  ``labels`` has (doc_id, y)."""
    read = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")).where("doc_id is not null").distinct()
    chosen = [read.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])  # 2 * per_class rows at most
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return rows.select("text", "y")


def _sentence_words(text: str):
    for m in _SENTENCE.finditer(text):
        yield {*_WORD.findall(m.group().lower())}


def _feature_counts(batches):
    """(feature, n0, n1): documents of each label that hold it, and all under null."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        total = [0, 0]
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            total[y] += 1
            for f in {f for w in {*_WORD.findall((text.as_py() or "").lower())} for f in word_features(w)}:
                counts.setdefault(f, [0, 0])[y] += 1
        names, pairs = [None, *counts], [total, *counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["feature", "n0", "n1"])


def _document_bags(index: dict[str, int]) -> Callable:
    """One row a document: label, how often each distinct bag occurs, sizes and features."""

    def run(batches):
        features = {}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                bags: dict[tuple, int] = {}
                for words in _sentence_words(text.as_py() or ""):
                    own = set()
                    for w in words:
                        if w not in features:
                            features[w] = [index[f] for f in word_features(w) if f in index]
                        own.update(features[w])
                    key = tuple(sorted(own))
                    bags[key] = bags.get(key, 0) + 1
                flat = [f for key in bags for f in key]
                columns = [pa.array([y], pa.int32()), *(pa.array([x], pa.list_(pa.int32())) for x in ([*bags.values()], [len(k) for k in bags], flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["y", "times", "sizes", "features"])

    return run


def training_bags(sample: DataFrame, min_docs: int = MIN_DOCS, screen: float = SCREEN) -> Bags:
    """The bags of ``sample`` (text, y).  Only features in ``min_docs`` documents whose share
    among toxic documents exceeds that among the others by ``screen`` standard errors take
    part.  Executors read the texts, whole; counted features that pass and, for each
    document of the bounded sample, its different bags of them reach the driver."""
    sample = cut(sample)
    counts = sample.mapInArrow(_feature_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all_ = counts.where("feature is null").first()
    n0, n1 = (all_["n0"], all_["n1"]) if all_ else (0, 0)
    if not n0 or not n1:
        return Bags(np.array([0] * n0 + [1] * n1), [], *(np.zeros(0, np.int64) for _ in range(4)))
    pooled = (F.col("n0") + F.col("n1")) / F.lit(n0 + n1)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * F.lit(1 / n0 + 1 / n1))
    kept = counts.where("feature is not null").where((F.col("n0") + F.col("n1") >= min_docs) & (F.col("n1") / F.lit(n1) - F.col("n0") / F.lit(n0) >= F.lit(screen) * error))
    features = sorted(r["feature"] for r in kept.select("feature").collect())
    index = {f: k for k, f in enumerate(features)}
    rows = sample.mapInArrow(_document_bags(index), "y int, times array<int>, sizes array<int>, features array<int>").toArrow()
    lists = [rows[c].combine_chunks() for c in ("times", "sizes", "features")]
    per_doc = np.diff(np.asarray(lists[0].offsets))
    times, sizes, feature = (np.asarray(x.flatten()).astype(np.int64) for x in lists)
    return Bags(np.asarray(rows["y"]), features, np.repeat(np.arange(len(per_doc)), per_doc), times, np.repeat(np.arange(len(sizes)), sizes), feature)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> NoisyOr:
    """The model fitted on the bounded sample of ``docs`` (doc_id, text) that ``labels`` name."""
    model = fit(training_bags(training_sample(docs, labels, per_class)))
    release()
    return model


def toxicity(docs: DataFrame, train_labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_off: float = CUT_OFF, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, score, predicted, offending of every row of ``docs``; ``train_labels`` has
    (doc_id, y).  ``offending`` lists (start, end, score) of the sentences, by characters,
    whose own score is 0.5 or more.

    The model is fitted on a bounded sample (``training_sample``) and scores every whole
    text, however long, in one pass without a shuffle.  Null or empty text: no sentence, score 0.  Null
    doc_id: scored, never trained on.  Repeated rows: each is scored, trained on once.
    Without labels of both kinds every score is about 0.  Empty table: no rows.  Other
    columns are not read.
    """
    read = texts(docs, id_col, text_col)
    model = train(read, train_labels, per_class)

    def score(batches):
        of = model.scorer()
        for batch in batches:
            scores, spots = [], []
            for text in batch.column("text"):
                s, scored = of(text.as_py())
                scores.append(s)
                spots.append([{"start": a, "end": b, "score": p} for a, b, p in scored if p >= 0.5])
            s = np.array(scores)
            spot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= cut_off).astype(np.int32)), pa.array(spots, spot)], names=["doc_id", "score", "predicted", "offending"])

    return read.mapInArrow(score, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, train_labels: DataFrame, cut_off: float = CUT_OFF, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is below ``cut_off``: ``toxicity`` as
    a filter, in one pass without a join.  Null texts count as empty and stay."""
    model = train(texts(docs), train_labels, per_class)
    bound_batches(docs.sparkSession)

    def keep(batches):
        of = model.scorer()
        for batch in batches:
            stays = [of(text.as_py() or "")[0] < cut_off for text in batch.column("text")]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` that may be learned from, as (doc_id, y)."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col("toxic").alias("y"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxicity`` of all documents, learned from two thirds of the labels."""
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))
