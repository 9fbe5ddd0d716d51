"""Text and vector search against brute force on small inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from millrace.functions import grams
from millrace.functions.grams import text_grams, with_grams
from millrace.operators import search, vectors
from millrace.plans import QUERIES


def test_grams_of_odd_texts(spark):
    texts = ["", "ab", "abcd", "Aé漢😀b", "aaaaaa", "a\nb c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: sorted(r.grams) for r in with_grams(docs, "id", "text", 4).collect()}
    assert got == {i: text_grams(t, 4) if t else [] for i, t in enumerate(texts)}


def _rows_made(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Generate" in line or "Join" in line]


@pytest.mark.parametrize("n", [1, 4, 9])
def test_index_counts_documents_of_each_gram(spark, n):
    rng = random.Random(n)
    texts = [None, "", "ab", "ABab abab", "Aé漢😀b", "a\nb\0c", "İi̇"] + ["".join(chr(rng.randrange(32, 0x2000)) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "id int, text string").repartition(3)
    lowered = [r.text for r in docs.select(F.lower("text").alias("text")).collect() if r.text]
    want = Counter(g for t in lowered for g in text_grams(t, n))
    index = search.ngram_index(docs, "id", "text", n)
    assert {r.gram: r.n_docs for r in index.collect()} == want
    assert not _rows_made(index)  # no row for each gram of a document


@pytest.mark.parametrize("n", [1, 4, 9])
def test_codes_tell_all_grams_apart(n):
    """Also of so many characters that a gram's numbers do not fit one integer."""
    rng = random.Random(n)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)), "", "ab", "\0\0\0\0\0\0\0\0\0\0", "\U0010ffff" * 12]
    assert dict(grams.gram_counts(texts, n)) == Counter(g for t in texts if t for g in text_grams(t, n))
    numbers = grams.GramNumbers(grams.code_points(texts[:1]), n)
    known, part = set(numbers.given().tolist()), texts[0][100:120]
    assert set(numbers.of(grams.code_points([part])).tolist()) <= known
    assert not known & set(numbers.of(grams.code_points([part[::-1].replace(part[3], "x")])).tolist()) or n == 1


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8, 1.0])
def test_similarity_finds_every_match(spark, threshold):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "the", "and"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(150)] + [(200, "ab"), (201, "")]
    needles = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(25)] + [(99, "ab")]
    found = search.ngram_similarity(
        spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text",
        spark.createDataFrame(needles, "item_id int, text string"), "item_id", "text", 4, threshold,
    )
    got = {(r.item_id, r.doc_id): r.score for r in found.collect()}
    want = {}
    for i, needle in needles:
        grams = set(text_grams(needle, 4))
        for d, text in docs:
            score = len(grams & set(text_grams(text, 4) if text else [])) / len(grams)
            if score >= threshold - 1e-12:
                want[(i, d)] = score
    assert got == pytest.approx(want)


def _needles_and_docs(n_docs, n_needles):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(300)]
    needles = [(i, " ".join(rng.choices(words, k=rng.randrange(4, 12)))) for i in range(n_needles)]
    needles += [(1000 + i, text) for i, (_, text) in enumerate(needles[:5])]  # ties
    docs = [(i, " ".join(rng.choices(words, k=30)) + " " + rng.choice(needles)[1]) for i in range(n_docs)] + [(-1, ""), (-2, None), (-3, "ab")]
    return needles, docs


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_best_needle_of_each_document(spark, threshold):
    needles, docs = _needles_and_docs(120, 30)
    found = search.best_needles(
        spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text",
        spark.createDataFrame(needles, "item_id int, text string"), "item_id", "text", 4, threshold,
    )
    want = {}
    for d, text in docs:
        held = set(text_grams(text, 4)) if text else set()
        scores = [(-len(held & set(text_grams(needle, 4))) / len(text_grams(needle, 4)), i) for i, needle in needles]
        if -min(scores)[0] >= threshold - 1e-12:
            want[d] = (min(scores)[1], -min(scores)[0])
    got = {r.doc_id: (r.item_id, r.score) for r in found.collect()}
    assert {d: i for d, (i, _) in got.items()} == {d: i for d, (i, _) in want.items()}
    assert [got[d][1] for d in want] == pytest.approx([score for _, score in want.values()])


def test_pairs_scored_grow_with_the_documents(spark, monkeypatch):
    counts = []
    scored = search._Needles.scored

    def counted(self, pairs, held):
        counts.append(pairs.count())
        return scored(self, pairs, held)

    monkeypatch.setattr(search._Needles, "scored", counted)
    for n_needles in (20, 80):
        needles, docs = _needles_and_docs(200, n_needles)
        args = spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(needles, "item_id int, text string"), "item_id", "text", 4, 0.3
        search.best_needles(*args).collect()
        assert sum(counts) <= 3 * len(docs)
        counts.clear()


@pytest.mark.parametrize("block", [4096, 7])
def test_needles_meet_documents_inside_their_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(search, "NEEDLE_BLOCK", block)
    needles, docs = _needles_and_docs(60, 30)
    needles += [(2000, "ab"), (2001, "AB"), (2002, ""), (2003, None), (None, "ab")]
    asked, texts = spark.createDataFrame(needles, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    best = search.best_needles(texts, "doc_id", "text", asked, "item_id", "text", 4, 0.6)
    pairs = search.ngram_similarity(texts, "doc_id", "text", asked, "item_id", "text", 4, 0.6)
    assert not _rows_made(best) and not _rows_made(pairs)  # no row for a gram, no join of pairs
    want = {}
    for d, text in docs:
        held = set(text_grams(text, 4)) if text else set()
        for i, needle in needles:
            of = set(text_grams(needle, 4)) if needle and i is not None else set()
            if of and len(held & of) / len(of) >= 0.6:
                want[d, i] = len(held & of) / len(of)
    assert {(r.doc_id, r.item_id): r.score for r in pairs.collect()} == want
    first = {d: min((-s, i) for (e, i), s in want.items() if e == d) for d, _ in want}
    assert {r.doc_id: (-r.score, r.item_id) for r in best.collect()} == first
    assert first[-3] == (-1.0, 2000)
    assert search.best_needles(texts, "doc_id", "text", asked.limit(0), "item_id", "text", 4, 0.6).count() == 0


def test_lookups_count_rows_under_each_condition(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") >= 700).alias("b"))
    lookups = {"x": ("AND", (F.col("a") == 0) & F.col("b")), "y": ("OR", (F.col("a") == 1) | F.col("b")), "none": ("AND", F.col("a") == 9)}
    got = {(r.lookup, r.op): r.n_rows for r in search.count_lookups(df, lookups).collect()}
    late = [i % 7 > 0 and i >= 700 for i in range(1000)]
    assert got == {("x", "AND"): sum(i % 3 == 0 and late[i] for i in range(1000)), ("y", "OR"): sum(i % 3 == 1 or late[i] for i in range(1000)), ("none", "AND"): 0}


def test_tokens_keep_letters_of_every_script(spark):
    docs = spark.createDataFrame([(1, "Größe, été 42! naïve_x"), (2, None), (3, "日本 — x")], "id int, text string")
    got = {(r.term, r.id) for r in search.inverted_postings(docs, "id", "text").collect()}
    assert got == {("größe", 1), ("été", 1), ("42", 1), ("naïve", 1), ("x", 1), ("日本", 3), ("x", 3)}


@pytest.mark.parametrize("query_block", [256, 4])
def test_nearest_by_one_block_or_many(spark, monkeypatch, query_block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    base[50:150] = base[50]  # a third of the vectors are copies
    base[7] = 0
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(base) @ unit(asked).T, 12)
    want = {(q, i, r + 1) for q in range(11) for r, i in enumerate(np.lexsort((np.arange(300), -scores[:, q]))[:5])}
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(900, None)], "id long, v array<double>")
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)] + [(99, None)], "query_id long, query array<double>")
    got = vectors.nearest(vecs, "id", "v", queries, 5).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want
    assert vectors.nearest(vecs, "id", "v", queries.limit(0), 5).count() == 0


def test_nearest_ranks_by_the_full_score(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.005]), (2, [1.0, 0.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    assert [r.id for r in vectors.nearest(vecs, "id", "v", queries, 1).collect()] == [2]


def test_sign_hashes_take_zero_and_null_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(300, [0.0] * 8), (301, None)]
    vecs = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame([(0, base[5].tolist()), (1, [0.0] * 8), (2, None)], "query_id long, query array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.nearest_coded(vecs, "id", "v", queries, 3).collect()}
    assert got[0, 1] == 5 and not any(q == 2 for q, _ in got)
    assert vectors.nearest_coded(vecs.limit(0), "id", "v", queries, 3).count() == 0


def test_approximate_recall(spark):
    exact = {(r.query_id, r.id) for r in QUERIES["vector_topk"](spark, SF_DIR).collect()}
    near = {(r.query_id, r.id) for r in QUERIES["vector_ann"](spark, SF_DIR).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_codes_hold_every_vector_and_a_tenth_is_scored(spark, monkeypatch):
    rng, sizes = np.random.default_rng(2), []
    rows = [(i, rng.normal(0, 1, 30).tolist()) for i in range(3000)] + [(5000 + i, [1.0] * 30) for i in range(1500)] + [(9000, [0.0] * 30), (9001, None)]
    vecs = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    queries = spark.createDataFrame([(q, rng.normal(0, 1, 30).tolist()) for q in range(20)], "query_id int, query array<double>")
    books = vectors.code_books(vecs.filter("v IS NOT NULL"), "v", 4501)
    codes = vectors.coded(vecs.filter("v IS NOT NULL"), books).collect()
    assert len(codes) == 4501 and {len(r.code) for r in codes} == {8}
    ranked = vectors._ranked
    monkeypatch.setattr(vectors, "_ranked", lambda df, k: sizes.append(k) or ranked(df, k))
    near = {(r.query_id, r.id) for r in vectors.nearest_coded(vecs, "id", "v", queries, 10).collect()}
    assert sizes == [200, 10]
    exact = {(r.query_id, r.id) for r in vectors.nearest(vecs, "id", "v", queries, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_sketch_is_close(spark):
    approx = sum(r.n_users for r in QUERIES["distinct_users_sketch"](spark, SF_DIR).collect())
    exact = QUERIES["distinct_users"](spark, SF_DIR)
    assert approx >= exact.agg(F.max("n_users")).first()[0]
