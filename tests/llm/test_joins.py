"""Operators 3, 5 and 9 and the pieces below them against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from helpers import components, documents, jaccard_components, sentence

from tidemark.llm import components as linking
from tidemark.llm import embedding_join, incidence
from tidemark.llm.common import span_hashes
from tidemark.llm.components import connected_components
from tidemark.llm.embedding_join import near_duplicate_embeddings
from tidemark.llm.ngram_join import ngram_jaccard_components
from tidemark.llm.substring_dedup import repeated_passages, tune_bands

DOCS = "doc_id long, text string"


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = components({x for e in real for x in e}, real)
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, node int, key int, n int").repartition(5)
    got = ngram_jaccard_components(df).collect()
    sizes, roots = jaccard_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], roots[r.doc_id]), r.doc_id


def test_ngram_join_with_frequent_columns_and_small_blocks(spark, monkeypatch):
    """Many near copies that don't all link: frequent columns, pivots and block products."""
    monkeypatch.setattr(incidence, "FREQUENT", 3)
    monkeypatch.setattr(incidence, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(linking, "BLOCK", 4)
    monkeypatch.setattr(linking, "BIG", 2)
    rng = random.Random(5)
    w = sentence(rng, 60).split()
    rows = []
    for i in range(60):
        v = list(w)
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(60)] = rng.choice(w)
        rows.append((i, " ".join(v)))
    sizes, roots = jaccard_components(rows)
    assert len(set(roots.values())) > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in sizes}


def test_ngram_join_of_nothing(spark):
    assert ngram_jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


def test_bands_are_tuned():
    bands, rows = tune_bands(0.8, 0.9999, 80)
    assert bands * rows <= 80 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert (1 - (1 - 0.8 ** (rows + 1)) ** (80 // (rows + 1))) < 0.9999


def test_repeated_passages(spark):
    rng = random.Random(3)
    passage = ". ".join(sentence(rng, 9).capitalize() for _ in range(7)) + "."
    line = sentence(rng, 50)
    near = line.split()
    near[25] = "changed"
    own = lambda: ". ".join(sentence(rng, 8).capitalize() for _ in range(6))
    rows = [
        (1, own() + " " + passage + " " + own()), (2, own() + " then " + passage + " " + own()), (3, own()), (4, own() + "\n" + line), (5, line + "\n" + own()),
        (6, own() + "\n" + " ".join(near)), (7, None), (8, ""), (9, "boiler plate line\n" + own()), (10, "boiler plate line\n" + own()), (None, line),
    ]
    got = repeated_passages(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kind string")).collect()
    paragraphs = {r.doc_id: (r.component_id, r.kept) for r in got if r.kind == "paragraph"}
    passages = {(r.doc_id, r.component_id, r.kept) for r in got if r.kind == "passage"}
    assert paragraphs == {4: (4, True), 5: (4, False), 6: (4, False)}
    assert {(1, 1, True), (2, 1, False), (4, 4, True), (5, 4, False)} <= passages
    assert {3, 9, 10}.isdisjoint({r.doc_id for r in got})
    assert all(r.component_id <= r.doc_id and (not r.kept or r.component_id == r.doc_id) for r in got)
    assert repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def unique_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def test_random_pastes_against_brute_force(spark):
    """Runs of 50 words and more, pasted anywhere: every pair is found, every word that goes
    has a copy that stays, and words that nobody else has stay, bar a window's edge."""
    rng = random.Random(23)
    pool = [unique_words(rng, rng.randint(50, 90)) for _ in range(40)]
    rows, spans = [], {}
    for i in range(120):
        words = unique_words(rng, rng.randint(5, 60))
        for k in rng.sample(range(40), rng.randint(0, 3)):
            spans.setdefault(i, []).append((len(words), len(words) + len(pool[k]), k))
            words += pool[k] + unique_words(rng, rng.choice([0, 1, 2, 9, 40]))
        rows.append((i, words))
    # Once alone and with a repeat in the same document only.
    alone = unique_words(rng, 60)
    rows.append((500, alone + unique_words(rng, 5) + alone))
    df = spark.createDataFrame([(i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)) for i, words in rows], DOCS).repartition(5)
    got = repeated_passages(df, min_words=10**6).collect()
    holders = {k: {i for i, found in spans.items() for _, _, own in found if own == k} for k in range(40)}
    pairs = missed = 0
    for i, found in spans.items():
        for a, b, k in found:
            if len(holders[k]) > 1:
                pairs += 1
                missed += not any(r.doc_id == i and min(r.last + 1, b) - max(r.first, a) >= 28 for r in got)
    assert pairs > 60 and missed == 0
    assert 500 not in {r.doc_id for r in got}
    text = dict(rows)
    gone = {(r.doc_id, at) for r in got if not r.kept for at in range(r.first, r.last + 1)}
    stay = {w for i, words in rows for at, w in enumerate(words) if (i, at) not in gone}
    count = {}
    for _, words in rows:
        for w in words:
            count[w] = count.get(w, 0) + 1
    lost = {text[i][at] for i, at in gone} - stay
    assert all(count[w] == 1 for w in lost)  # what anybody shares has a copy left
    for r in got:  # unique words in a row: at most four, a shingle less one
        run = longest = 0
        for w in text[r.doc_id][r.first : r.last + 1]:
            run = run + 1 if count[w] == 1 else 0
            longest = max(longest, run)
        assert r.kept or longest <= 4


def test_paragraph_recall_against_brute_force(spark):
    """Edited lines: of the pairs with similarity 0.8 or more nine tenths at least share a
    class (all, as measured), and no others."""
    rng = random.Random(29)
    rows = []
    for k in range(80):
        base = sentence(rng, rng.randint(26, 120)).split()
        for j in range(4):
            v = list(base)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(["new", "other", "else"])
            rows.append((4 * k + j, " ".join(v)))
    got = {r.doc_id: r.component_id for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect() if r.kind == "paragraph"}
    sizes, roots = jaccard_components(rows)
    groups = {}
    for i, c in roots.items():
        groups.setdefault(c, []).append(i)
    pairs = [(a, b) for g in groups.values() for a, b in combinations(g, 2)]
    found = sum(a in got and got.get(a) == got.get(b) for a, b in pairs)
    assert len(pairs) > 100 and found >= 0.99 * len(pairs)
    assert all(roots[i] == roots[c] for i, c in got.items())


def test_words_whose_hashes_could_collide(spark):
    """Thue-Morse words and their complements, which polynomial hashes confuse."""
    def morse(n):
        return "".join("ab"[bin(i).count("1") % 2] for i in range(n))

    for n in (8, 16, 64, 65, 1024, 2048):
        one = morse(n)
        other = one.translate(str.maketrans("ab", "ba"))
        assert len({int(h) for h in span_hashes(np.frombuffer((one + other).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n]))}) == 2
    rest = sentence(random.Random(1), 60)
    rows = [(1, morse(2048)), (2, morse(2048).translate(str.maketrans("ab", "ba"))), (3, f"{rest} {morse(1024)}\n"), (4, morse(2048).upper())]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_passages_within_a_sentence(spark):
    """50 words pasted inside a sentence without stops, also where no piece of them is whole."""
    rng = random.Random(13)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    rows, pasted = [], {}
    for k in range(150):
        pasted[k] = words(50)
        rows += [(2 * k, f"{words(40)} {pasted[k]} {words(40)}"), (2 * k + 1, f"{words(31)} {pasted[k].upper()} {words(27)}")]
    got = [r for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect() if r.kind == "passage"]
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    texts = {i: t.lower().split() for i, t in rows}
    for r in got:
        assert r.component_id == r.doc_id // 2 * 2 and r.kept == (r.doc_id == r.component_id)
        own = texts[r.doc_id][r.first : r.last + 1]
        assert sum(w in pasted[r.doc_id // 2].split() for w in own) >= len(own) - 4


def test_null_ids_before_their_twins(spark):
    rng = random.Random(17)
    text = sentence(rng, 60)
    near = text.split()
    near[30] = "changed"
    df = spark.createDataFrame([(None, text), (5, text), (6, " ".join(near))], DOCS).coalesce(1)
    assert {(r.doc_id, r.component_id) for r in ngram_jaccard_components(df).collect()} == {(None, None), (5, 5), (6, 5)}
    got = [r for r in repeated_passages(df).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 5, True), (6, 5, False)}


@pytest.mark.parametrize("block", [8, 64])
def test_embedding_join(spark, block):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    vectors = [(centres[i % 6] + rng.normal(scale=0.25, size=12)).tolist() for i in range(120)] + rng.normal(size=(60, 12)).tolist()
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]]]
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0] * 3, [2.0] * 3]
    rows = [(i, v, 1.0) for i, v in enumerate(vectors + odd)]
    got = {r.vec_id: r for r in near_duplicate_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, weight double").repartition(3), block=block).collect()}
    x = np.array(vectors)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = [(a, b) for a, b in combinations(range(len(x)), 2) if near[a, b]] + [(len(x) + 6, len(x) + 7)]
    roots = components(range(len(rows)), links)
    count = {i: 0 for i in range(len(rows))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (count[i], roots[i], roots[i] == i) for i in range(len(rows))}
    assert near_duplicate_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    null = near_duplicate_embeddings(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<double>")).first()
    assert (null.n_links, null.component_id, null.kept) == (0, None, False)


def test_embedding_join_of_many_lengths_and_repeated_ids(spark, monkeypatch):
    """More lengths than have pivots, each with a pair that links; ids that occur again."""
    monkeypatch.setattr(embedding_join, "PIVOTED_LENGTHS", 2)
    rng = np.random.default_rng(3)
    rows = []
    for n in range(2, 60):
        v = rng.normal(size=n)
        rows += [(3 * n, v.tolist()), (3 * n + 1, (1.0001 * v + 1e-4).tolist()), (3 * n + 2, (-v).tolist())]
    rows += [(5000, [1.0, 0.0]), (5000, [1.0, 0.0]), (5000, [0.0, 1.0])]
    got = near_duplicate_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=2).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: r for r in got}
    for n in range(3, 60):
        assert (by_id[3 * n].n_links, by_id[3 * n + 1].component_id, by_id[3 * n + 2].kept) == (1, 3 * n, True), n
    assert sorted(r.n_links for r in got if r.vec_id == 5000)[-1] >= 1
