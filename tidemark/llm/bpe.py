"""Operator 7: byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, release, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS = 1 << 16
# A letter or digit with a space after it: the pattern's match ends there whatever
# follows or precedes, so the matches of both sides are those of the whole.
_SAFE = re.compile(r"[^\W_](?= )")
# The white space of the pattern's \s.
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
LONG_BLANK = 1 << 14
_LONG_BLANKS = re.compile(f"{_BLANK}{{{LONG_BLANK},}}")
_LOADED: dict[tuple, object] = kept()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; loaded once in each Python worker."""
    import tiktoken

    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _LOADED[key]


def safe_chunks(text: str, size: int = CHUNK_CHARS):
    """Parts of about ``size`` characters, cut only where no match can span the cut."""
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:] if begin else text


def encode_text(enc, text: str, blanks: re.Pattern = _LONG_BLANKS) -> list[int]:
    """Ids of the whole text.  The pattern takes all of a run of white space but its last
    character as one match (all of it at the end of a text).  The library's matcher needs
    stack for each character of such a run and fails on a million, so a long one is found
    here and merged as the one piece that it is."""
    if len(text) < LONG_BLANK:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    begin = 0
    for run in blanks.finditer(text):
        stop = run.end() - (run.end() < len(text))
        if stop <= run.start():
            continue
        for part in safe_chunks(text[begin : run.start()]):
            ids += enc.encode_ordinary(part)
        ids += enc._encode_single_piece(text[run.start() : stop])
        begin = stop
    for part in safe_chunks(text[begin:] if begin else text):
        ids += enc.encode_ordinary(part)
    return ids


def _coder(path: str, pattern: str, digests: bool) -> Callable:
    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                counts, left, right = [], [], []
                for text in part.column("text"):
                    ids = encode_text(enc, text.as_py())
                    raw = np.array(ids, dtype="<u4").tobytes()
                    counts.append(len(ids))
                    if digests:
                        left.append(hashlib.sha256(raw).hexdigest())
                        right.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                    else:
                        left.append(raw)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(left)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(right)] * digests, names=["doc_id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids"]))
        release()

    return run


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every whole text.

    One pass without a shuffle; each match of ``pattern`` is merged on its own and the
    strings of special tokens are ordinary text.  ``ranks`` is the path of the rank file
    on every executor.  A text is encoded whole, however long; long ones in parts that no
    match spans.  Null or empty text: no tokens.  Null or repeated doc_id: the row
    is encoded like any other.  Empty table: no rows.  Other columns are not read.
    """
    return texts(docs, id_col, text_col).mapInArrow(_coder(ranks, pattern, False), "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: the raw bytes that the ids of ``encode`` stand for.

    Null or empty ids: no bytes.  Null or repeated doc_id: the row is decoded like any
    other.  Empty table: no rows.  Other columns are not read."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(np.frombuffer(x.as_py(), dtype="<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, bytes binary")


def encode_decode_digests(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode``, then ``decode``, reduced to
    digests in the same pass, so neither ids nor bytes leave the worker.

    Null or empty text: 0 and the digests of nothing.  Very long text, null or repeated
    doc_id, empty table and other columns: as for ``encode``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs, id_col, text_col).mapInArrow(_coder(ranks, pattern, True), schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_decode_digests`` of all documents."""
    return encode_decode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
