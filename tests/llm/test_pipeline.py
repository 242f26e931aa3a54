"""The pipeline's stages, each against what its operator says of its own input."""

import random

import corpus_pipeline as pipeline
import public_tokenizers
from helpers import jaccard_components, sentence

from tidemark.llm import bpe

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert 4 <= len(pipeline.STAGES) <= 5
    before = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, SF)
        rows = after.collect()
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in rows}
        assert set(new) <= set(old)
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name == "toxicity":
            clean = {i for i, y in toxic.items() if y == 0 and i in old}
            assert len(clean - set(new)) <= 0.01 * len(clean)
            assert len([i for i, y in toxic.items() if y == 1 and i in new]) <= 0.2 * sum(toxic.values())
        elif name == "line dedup":
            assert set(new) == set(old)
        elif name == "n-gram Jaccard join":
            _, roots = jaccard_components([(i, r.text) for i, r in old.items()])
            assert set(new) == {i for i, root in roots.items() if i == root}
        elif name == "benchmark decontamination":
            assert set(old) - set(new) >= {i for i, r in old.items() if any(t in r.text for t in items)}
        else:
            enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
            assert {i: r.n_tokens for i, r in new.items()} == {i: len(enc.encode_ordinary(r.text)) for i, r in old.items()}
        before = spark.createDataFrame(rows, after.schema)


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_sha256" in out.columns


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_are_not_boilerplate(spark):
    """A third of a source are copies, exact and near; lines of other documents repeat."""
    rng = random.Random(19)
    base = [sentence(rng, 12) for _ in range(12)]
    notice = "all of this is a notice"
    texts = {}
    for i in range(30):
        near = list(base)
        near[i % 12] = " ".join(near[i % 12].split()[:-1] + ["changed"])
        texts[i] = "\n".join(base if i % 2 else near)
    for i in range(30, 80):
        texts[i] = "\n".join([notice] * (i % 2) + [sentence(rng, 12) for _ in range(3)])
    texts |= {i: notice for i in range(80, 90)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, notice, "en", "s", len(notice)), (91, None, "en", "s", None)]
    got = {r.doc_id: r for r in pipeline.drop_source_lines(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, t in texts.items():
        expected = t.replace(notice + "\n", "") if i < 80 else t if i == 80 else ""
        assert (got[i].text, got[i].n_chars) == (expected, len(expected)), i
    assert got[None].text == notice and got[91].text is None


def test_boilerplate_goes_in_every_source(spark):
    """Lines on 4, 4 and 10 of 100 documents of a source go, one on 2 stays."""
    rng = random.Random(23)
    planted = {n: sentence(rng, 8) for n in (3, 4, 9)}
    rare = sentence(rng, 8)
    rows = []
    for source in range(4):
        for i in range(100):
            lines = [sentence(rng, 12) for _ in range(3)] + [line for n, line in planted.items() if i % (100 // n) == 0] + [rare] * (i < 2)
            rows.append((100 * source + i, "\n".join(lines), "en", f"s{source}", 0))
    got = [r.text.split("\n") for r in pipeline.drop_source_lines(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), SF).collect()]
    assert not [t for t in got if set(t) & set(planted.values())]
    assert sum(rare in t for t in got) == 8


def stage_of(name):
    return dict(pipeline.STAGES)[name]


def test_stages_take_awkward_rows(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, repeated rows, extra columns
    with names that clash, and an empty table."""
    rng = random.Random(31)
    item = sentence(rng, 20)
    base = sentence(rng, 40)
    rows = [
        (1, base), (2, base), (2, "another text " + sentence(rng, 30)), (3, f"{sentence(rng, 30)} {item}"), (3, sentence(rng, 40)), (4, None), (5, ""), (5, ""), (6, "  \n "),
        (None, base), (None, f"{item} {sentence(rng, 20)}"), (7, sentence(rng, 120_000)), (8, base + " more"), (1, base), (9, "same id " + sentence(rng, 30)),
    ]
    rows.append(rows[-1])
    full = [(i, t, "en", None if i == 6 else "s", None if t is None else len(t), 1, 2, "x", 3) for i, t in rows]
    schema = COLUMNS + ", node int, n int, key string, w int"
    spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(full, schema).repartition(3)
    kept = {}
    for name, stage in pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns or name == "byte-level BPE"
            kept[name] = kept.get(name) or sorted((str(r.doc_id), getattr(r, "text", None) or "") for r in out.collect())
            assert table is docs or out.count() == 0
    whole = sorted((str(i), t or "") for i, t in rows)
    assert kept["toxicity"] == whole and [i for i, _ in kept["line dedup"]] == [i for i, _ in whole]
    # Copies of 1 go (8 is a near one), once per row; ids that occur again keep their other texts.
    gone = [("1", base), ("2", base), ("8", base + " more"), ("9", rows[-1][1])]
    left = list(whole)
    for g in gone:
        left.remove(g)
    assert kept["n-gram Jaccard join"] == left
    assert kept["benchmark decontamination"] == [r for r in whole if item not in r[1]]
    assert len(kept["byte-level BPE"]) == len(rows)
