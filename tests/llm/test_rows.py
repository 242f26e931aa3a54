"""Operators that answer row by row: 1, 2, 4, 6, 7, 8, 10."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, sentence

from tidemark.llm import bpe, decontaminate, licenses, line_dedup, quality, token_count, toxicity

DOCS = "doc_id long, text string"
AWKWARD = "doc_id long, text string, score int, ids int, h int, row int, host string"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x") for i, t in rows], AWKWARD)


def test_bpe_is_tiktokens(spark):
    rows = documents(4, 10) + [(900, "word " * 40_000), (901, "a" * 70_000), (902, "don't <|endoftext|> \t\n x² 3½ ")]
    path = public_tokenizers.path(bpe.RANKS)
    enc = bpe.encoding(path, public_tokenizers.PATTERN)
    got = bpe.encode_decode_digests(awkward(spark, rows), path).collect()
    assert len(got) == len(rows)
    expected = {}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        expected[(i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] = (len(ids), hashlib.sha256((t or "").encode()).hexdigest())
    assert {((r.doc_id, r.ids_sha256), (r.n_tokens, r.decoded_sha256)) for r in got} == set(expected.items())
    back = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS), path), path)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(spark.createDataFrame([], DOCS), path).count() == 0


def test_safe_chunks_keep_the_matches():
    import regex

    rng = random.Random(2)
    alphabet = "ab1² .'\n\t-sé"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(120))
        parts = list(bpe.safe_chunks(text, 10))
        assert "".join(parts) == text
        assert sum((regex.findall(public_tokenizers.PATTERN, p) for p in parts), []) == regex.findall(public_tokenizers.PATTERN, text)


def test_long_white_space():
    """Runs of several million, and short ones taken for long, against tiktoken itself."""
    import re

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert bpe.encode_text(enc, "a" + " " * 200_000 + "b") == enc.encode_ordinary("a" + " " * 200_000 + "b")
    for run in (" ", " \n\u3000"):
        text = "word " + run * 3_000_000 + "word"
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids) == text.encode()
    rng = random.Random(3)
    short = re.compile(f"{bpe._BLANK}{{2,}}")
    size, bpe.LONG_BLANK = bpe.LONG_BLANK, 1
    try:
        for _ in range(400):
            text = "".join(rng.choice("ab1'st.  \t\n\x1f\x85\u3000é") for _ in range(40))
            assert bpe.encode_text(enc, text, short) == enc.encode_ordinary(text), text
    finally:
        bpe.LONG_BLANK = size


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    odd = ["".join(rng.choice("abc st're'll d 12\n\t .,!é中🙂’'") for _ in range(80)) for _ in range(200)]
    morse = ["".join("ab"[bin(i).count("1") % 2] for i in range(n)) for n in (32, 64, 1024, 2048)]
    odd += morse + [m.translate(str.maketrans("ab", "ba")) for m in morse]
    rows = documents(6, 10) + [(1000 + i, t) for i, t in enumerate(odd + ["a" * 9000, "ab" * 5000, "the<|endoftext|>end", " " * 3000, "I'm we've 's's ''s"])]
    path = public_tokenizers.path(token_count.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = token_count.token_counts(awkward(spark, rows), path).collect()
    expected = sorted((str(i), len((t or "").encode()), n, n > 512) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
    assert token_count.token_counts(spark.createDataFrame([], DOCS), path).count() == 0


def test_token_counts_survive_a_small_table():
    machine = token_count.Transducer(public_tokenizers.path(token_count.TOKENIZER), max_states=50)
    data = np.frombuffer(b"several words that do not fit the table of states at once", np.uint8)
    one = token_count.count_batch(machine, data, np.array([0, len(data)]))
    assert one.tolist() == token_count.count_batch(machine, data, np.array([0, len(data)])).tolist()


PAGES = [(i, "http://A.example/x", f"<nav>Home</nav><p>story {i}</p><p>&lt;b&gt;</p><script>var x='<p>no</p>'</script>") for i in range(9)]


def test_page_lines(spark):
    rows = [*PAGES, (9, "https://b.example:80/", "<p>only</p>"), (10, None, None), (11, "https://b.example", ""), (None, "nonsense", "<p>x</p>")]
    got = {r.page_id: r for r in line_dedup.dedup_page_lines(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, drop int")).collect()}
    assert got[3].host == "a.example" and got[3].n_lines == 3 and got[3].n_dropped == 2
    assert got[3].kept_text.split() == ["story", "3"]
    assert got[9].kept_text.strip() == "only" and got[9].n_dropped == 0
    assert (got[10].kept_text, got[10].n_lines) == ("", 0) and got[None].n_dropped == 0
    assert line_dedup.dedup_page_lines(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_document_lines_change_only_what_is_boilerplate(spark):
    rows = [(i, f"same line\nown {i}", "en", "s", 99) for i in range(5)] + [(9, None, None, None, None), (10, "other", "en", "t", 5)]
    got = {r.doc_id: r for r in line_dedup.dedup_document_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[2].text == "own 2" and got[2].n_chars == 5
    assert got[9].text is None and got[10].text == "other" and got[10].n_chars == 5


def test_licenses(spark):
    mit = licenses._MIT
    variant = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ,\n")
    rows = [(1, mit), (2, variant), (3, "text\nReleased under the MIT License.\nAll rights reserved."), (4, None), (5, ""), (6, mit + " and more"), (None, mit), (1, mit)]
    for known in (None, licenses.known_licenses(spark)):
        got = sorted(((r.doc_id or 0, r.license, r.notices) for r in licenses.scan_licenses(awkward(spark, rows), known).collect()), key=str)
        answers = {a: (b, c) for a, b, c in got}
        assert len(got) == len(rows)
        assert answers[1][0] == answers[2][0] == answers[0][0] == "MIT"
        assert answers[3] == (None, "LicenseRef-All-Rights-Reserved,MIT") and answers[4] == answers[5] == (None, "") and answers[6][0] is None
    many = licenses.known_licenses(spark)
    old, licenses.LITERAL_ROWS = licenses.LITERAL_ROWS, 2
    try:
        joined = {(r.doc_id, r.license, r.notices) for r in licenses.scan_licenses(awkward(spark, rows), many).collect()}
    finally:
        licenses.LITERAL_ROWS = old
    assert joined == {(r.doc_id, r.license, r.notices) for r in licenses.scan_licenses(awkward(spark, rows)).collect()}
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


ITEM = "Anna has 12 apples and gives 5 apples to Boris who then walks 3 km home with Anna and her 12 apples left"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_PASSAGES", broadcast)
    rng = random.Random(1)
    pad = sentence(rng, 30)
    other = ITEM.replace("Anna", "Carla").replace("Boris", "Dimitri").replace("12", "40").replace("km", "miles")
    names = iter(("Carla", "Emil", "Fred"))
    numbers = iter(("40", "41", "42", "43"))
    broken = " ".join(next(names) if w in ("Anna", "Boris") else next(numbers) if w.isdigit() and w != "3" else w for w in ITEM.split())  # the later slots don't follow
    rows = [(1, f"{pad} {ITEM} {pad}"), (2, f"{pad} {other}"), (3, f"{pad} {broken} {pad}"), (4, pad), (5, None), (6, ""), (None, ITEM), (1, f"{pad} {ITEM} {pad}"), (7, "tiny item here now")]
    items = [(10, ITEM), (10, ITEM), (11, None), (12, "tiny item here now"), (None, pad)]
    got = decontaminate.contaminated_passages(awkward(spark, rows), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, key int")).collect()
    assert sorted((str(r.doc_id), r.item_id, r.reparameterised) for r in got) == [("1", 10, False), ("1", 10, False), ("2", 10, True), ("7", 12, False), ("None", 10, False)]
    assert next(r.first_word for r in got if r.doc_id == 1) == 30
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_passages(awkward(spark, rows), empty).count() == 0


def test_contamination_of_short_and_recased_items(spark):
    rng = random.Random(4)
    pad = sentence(rng, 12)
    short, long_name = "What is 12 + 30 - 7 ?", ITEM.replace("Boris", "Boris van Dyk")
    edited = ITEM.replace("with Anna", "with Carla")  # one of two equal names
    merged = ITEM.replace("Boris", "Anna")
    rows = [(1, f"{pad} {short}"), (2, f"{pad} {ITEM.lower()} {pad}"), (3, f"{ITEM.upper()} {pad}"), (4, f"{pad} {long_name}"), (5, edited), (6, merged), (7, f"{pad} What is 13 + 30 - 7 ?"), (8, "12 13 14 15 16 17 18 19 20 21 22 23 " * 50)]
    items = [(1, ITEM), (2, short), (3, "1 2 3 4 5 6 7 8 9 10 11 12")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)}


def test_contamination_against_brute_force(spark):
    """Items whole, cut, with other values, in one case, and unrelated texts: which documents
    are found, against what was planted."""
    rng = random.Random(31)
    names = ["Anna", "Boris", "Carla", "Dimitri", "Emil", "Farah"]
    items, rows, planted, value = [], [], set(), {}
    for k in range(30):
        words = sentence(rng, rng.randint(12, 40)).split()
        for at in rng.sample(range(len(words)), len(words) // 5):
            words[at] = rng.choice([*names, str(rng.randint(2, 99))])
        items.append((k, " ".join(words)))
    pads = lambda: sentence(rng, rng.randint(20, 60))
    for i in range(300):
        k = rng.randrange(30)
        words = items[k][1].split()
        value = {w: rng.choice([n for n in names if n != w]) if w in names else str(rng.randint(100, 999)) for w in set(words) if w in names or w.isdigit()}
        how = i % 6
        if how == 0:
            body = words
        elif how == 1:
            body = [value.get(w, w) for w in words]
        elif how == 2:
            body = [w.lower() for w in words]
        elif how == 3:
            body = words[: max(len(words) * 3 // 4, 9)]
        elif how == 4:
            body = [w.upper() for w in words]
        else:
            body = []
        if body:
            planted.add((i, k))
        rows.append((i, f"{pads()} {' '.join(body)} {pads()}"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(planted & got) >= 0.97 * len(planted)
    assert not {i for i, _ in got} & set(range(5, 300, 6))


def test_contamination_finds_all_planted_items(spark):
    root = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_passages(docs, items).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    planted = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if d.text and t in d.text}
    assert planted and planted <= got


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, ". ".join(sentence(rng, 9).capitalize() for _ in range(rng.randint(3, 9)))) for i in range(120)]
    bad = [(1000 + i, (rng.choice(["SPAM!! ", "zz| "]) * rng.randint(20, 60))) for i in range(60)]
    rows = good + bad + [(5000, None), (5001, ""), (None, "x")]
    labels = [(i, 1) for i, _ in good if i % 3] + [(i, 0) for i, _ in bad if i % 3] + [(good[0][0], None), (None, 1)]
    got = {r.doc_id: r for r in quality.quality_scores(awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, y int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, 1) for i, _ in good if i % 3 == 0] + [(got[i].predicted, 0) for i, _ in bad if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    none = quality.quality_scores(spark.createDataFrame(rows[:3], DOCS), spark.createDataFrame([], "doc_id long, y int")).collect()
    assert [r.score for r in none] == [0.5] * 3


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = rng.normal(size=(5, d))
    means, factors, offsets, direct = [], [], [], []
    for k in range(2):
        a = rng.normal(size=(d, d))
        c = a @ a.T + np.eye(d)
        m = rng.normal(size=d)
        chol = np.linalg.cholesky(c)
        means.append(m)
        factors.append(np.linalg.inv(chol))
        offsets.append(np.log(0.5) - np.log(np.diag(chol)).sum())
        direct.append([np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - m) @ np.linalg.solve(c, v - m) for v in x])
    model = quality.QuadraticDiscriminant(np.array(means), np.array(factors), np.array(offsets))
    diff = np.array(direct[1]) - np.array(direct[0])
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.clip(diff, -60, 60))))


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        parts = [sentence(rng, 8).capitalize() for _ in range(6)]
        y = i % 3 == 0
        if y:
            parts[rng.randrange(6)] += " " + rng.choice(["vile", "rotten", "foulish", "foulest"])
        rows.append((i, ". ".join(parts)))
        if i % 4:
            labels.append((i, int(y)))
    rows += [(1000, None), (1001, ""), (None, "vile")]
    got = {r.doc_id: r for r in toxicity.toxicity(awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, y int")).collect()}
    held = [(got[i].predicted, int(i % 3 == 0)) for i in range(0, 400, 4)]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[1000].score == got[1001].score == 0
    hit = next(r for i, r in got.items() if i is not None and i < 400 and r.predicted)
    text = dict(rows)[hit.doc_id]
    assert any(w in text[hit.offending[0].start : hit.offending[0].end] for w in ("vile", "rotten", "foul"))
    kept = toxicity.drop_toxic(awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, y int"))
    assert kept.schema == awkward(spark, rows).schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, r in got.items() if not r.predicted)
    assert toxicity.toxicity(spark.createDataFrame(rows[:2], DOCS), spark.createDataFrame([], "doc_id long, y int")).first().predicted == 0
