"""The registered queries as they are called: columns, types, splits, thresholds, and what
they give for rows that are null, empty, very long, repeated, or come with clashing columns."""

import random
import zlib

import numpy as np
import pytest
from helpers import documents, jaccard_components, sentence
from pyspark.sql import functions as F

from tidemark.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_substring_dedup": {"doc_id": "bigint", "kind": "string", "first": "bigint", "last": "bigint", "n_words": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "first_word": "int", "n_words": "int", "coverage": "double", "reparameterised": "boolean"},
    "op7_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
PER_DOCUMENT = [n for n in COLUMNS if n not in ("op3_substring_dedup", "op5_embedding_near_dedup", "op6_decontaminate")]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def write_tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None, 1, 2.0, "x") for i, t in docs], DOCS + ", node int, score double, key string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
    table, key = ("embeddings", "vec_id") if name.startswith("op5") else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    got = [r[0] for r in df.select(key).collect()]
    assert sorted(got) == ids if name in PER_DOCUMENT or name.startswith("op5") else set(got) <= set(ids)


@pytest.mark.parametrize(("name", "modulus", "rest", "cut"), [("op1_quality", 5, 0, 0.3), ("op10_toxicity", 3, 1, 0.7)])
def test_held_out_labels_are_not_learned_from(spark, tmp_path, name, modulus, rest, cut):
    """Labels of held-out rows turned round change no score; those of the others do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % modulus == rest
    scores = {}
    for case, flip in (("as is", F.lit(False)), ("held", held), ("others", ~held)):
        folder = tmp_path / case.replace(" ", "")
        docs.drop("lang", "source").write.parquet(f"{folder}/documents.parquet")  # no inputs of a score
        turned = labels.select("doc_id", *[F.when(flip, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
        turned.write.parquet(f"{folder}/labels.parquet")
        rows = QUERIES[name](spark, str(folder)).collect()
        scores[case] = {r.doc_id: r.score for r in rows}
        assert all(r.held_out == (crc(r.doc_id) % modulus == rest) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert scores["as is"] == pytest.approx(scores["held"], abs=1e-9)
    assert name.startswith("op10") or scores["as is"] != pytest.approx(scores["others"], abs=1e-3)


@pytest.mark.parametrize("name", [*PER_DOCUMENT, "op3_substring_dedup", "op4_license_scan", "op6_decontaminate"])
def test_awkward_rows_and_empty_tables(spark, tmp_path, name):
    rng = random.Random(2)
    rows = documents(7, 12)
    long = sentence(rng, 150_000)
    rows += [(9000, long), (9001, long + " more"), (9002, " " * 200_000), (9003, "é" * 100_000), rows[0], rows[0], (rows[1][0], "another text")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)]
    folder = write_tables(spark, tmp_path / "full", rows, labels, [(1, sentence(rng, 12)), (2, None), (None, "a b c d e f g h i j"), (3, "")])
    got = QUERIES[name](spark, folder).collect()
    if name in PER_DOCUMENT or name == "op4_license_scan":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    if name == "op3_substring_dedup":
        assert {9000, 9001} <= {r.doc_id for r in got} and not {9002, None} & {r.doc_id for r in got}
    if name == "op9_ngram_jaccard_join":
        first = dict(reversed([(i, t) for i, t in rows if t != "another text"]))
        sizes, roots = jaccard_components(list(first.items()))
        by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.n_shingles == sizes[r.doc_id]}
        assert {i: r.component_id for i, r in by_id.items()} == roots
    empty = write_tables(spark, tmp_path / "empty", [], [], [])
    assert QUERIES[name](spark, empty).collect() == []


def test_lines_of_pages_at_the_ratio(spark, tmp_path):
    """A line on exactly a tenth of the pages stays, on one page more it goes; repeated rows
    are pages; one page is very long."""
    pages = [(i, "http://h.example/p", f"<p>own {i}</p>" + "<p>tenth</p>" * (i < 4) + "<p>more</p>" * (i < 5)) for i in range(39)]
    pages.append((39, "http://h.example/long", "".join(f"<p>line {k}</p>" for k in range(60_000))))
    spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, drop int, line string").write.parquet(f"{tmp_path}/a/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op2_line_dedup"](spark, f"{tmp_path}/a").collect()}
    assert "tenth" in got[0].kept_text and "more" not in got[0].kept_text and got[39].n_lines == 60_000 and got[39].n_dropped == 0
    spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    again = [r for r in QUERIES["op2_line_dedup"](spark, f"{tmp_path}/b").collect() if r.page_id == 0]
    assert len(again) == 2 and all("tenth" not in r.kept_text for r in again)


def test_links_of_registered_embeddings_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in QUERIES["op5_embedding_near_dedup"](spark, SF).collect()}
    assert got == {r.vec_id: int(n) for r, n in zip(rows, near, strict=True)}
