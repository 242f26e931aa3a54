"""A corpus pipeline of five operators: documents in, token counts out.

Toxic documents go, boilerplate lines of a source go, one document of each group of near
duplicates stays, documents that hold a benchmark item go, and the rest is encoded.

Each stage takes the rows that the one before it kept and decides on each row by its own
text: ids may be null or occur again.  All stages but the last return the columns of their
input, extra ones included.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import RANKS, encode_decode_digests
from tidemark.llm.common import checkpoint_folder
from tidemark.llm.decontaminate import drop_contaminated as without_benchmark
from tidemark.llm.line_dedup import dedup_document_lines
from tidemark.llm.ngram_join import keep_one_of_each_class
from tidemark.llm.toxicity import drop_toxic, training_labels


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the cut-off, learned from two thirds of the labels.

    Null and empty texts have no sentence and stay, repeated rows are scored alike, very
    long texts are scored whole, an empty table stays empty."""
    return drop_toxic(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_source_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat across the documents of their source.

    Exact and near copies of a document count once.  Null and empty texts stay as they are,
    a null source is a source, very long texts are read whole, an empty table stays empty."""
    return dedup_document_lines(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the smallest doc_id, once.

    Rows without words (null and empty texts) and rows with a null doc_id stay; repeated
    rows are copies; ties on doc_id go to the text with the smallest hash; very long texts
    are compared whole; an empty table stays empty."""
    return keep_one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark.

    Null and empty texts stay, repeated rows go or stay together, very long texts are read
    whole, an empty table or benchmark drops nothing."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of every row.

    Null texts count as empty and give no ids, repeated rows are encoded each, very long
    texts are encoded whole, an empty table stays empty."""
    return encode_decode_digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line dedup", drop_source_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL can express neither the learned toxicity scores nor the encoding; tests/llm holds
#: the stages against plain Python versions.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written to the shared checkpoint folder
    and read again; what a stage wrote goes when the next one has written.  The last
    folder feeds the result and stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    return docs
