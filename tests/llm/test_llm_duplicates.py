"""Near-duplicates, repeated passages and decontamination against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from samples import awkward, prose, same_rows

from millrace.llm import decontaminate, passages, simhash
from millrace.llm.common import numbered


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    df = awkward(spark)
    for r in simhash.near_duplicates(df).withColumnRenamed("doc_id", "id").join(df.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("text").alias("texts")), "id").collect():
        assert r.fingerprint in {f"{slow_fingerprint(t):016x}" for t in [*r.texts, None]}


def slow_components(prints):
    roots = list(range(len(prints)))

    def find(k):
        while roots[k] != k:
            k = roots[k]
        return k

    values = np.array(prints, dtype=np.int64).view(np.uint64)
    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values[k + 1 :]) <= 2).tolist():
            a, b = sorted((find(k), find(k + 1 + j)), key=lambda x: prints[x])
            roots[b] = a
    return {p: prints[find(k)] for k, p in enumerate(prints)}


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_components_of_chains_and_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    prints = set()
    for _ in range(30):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):  # a walk of up to three bits a step
            prints.add(value)
            for _ in range(rng.choice([1, 2, 2, 3])):
                value ^= 1 << rng.randrange(64)
    prints |= {0, 2**64 - 1, 1 << 63, 3, 7}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = slow_components(signed)
    written = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.fp: r.root for r in simhash._roots(written).collect()}
    assert got == want


def test_one_document_of_each_group_stays(spark):
    df = awkward(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    prints = defaultdict(list)
    for r in df.collect():
        prints[slow_fingerprint(r.text)].append(r.doc_id)
    named = {p: min((i for i in ids if i is not None), default=None) for p, ids in prints.items()}
    assert sorted((slow_fingerprint(r.text), r.doc_id) for r in rows) == sorted(named.items())
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"edit{rng.randrange(10**6)}"
    return out


def test_repeated_passages(spark):
    rng = random.Random(8)
    words = lambda n: prose(rng, n).split()
    shared, short, near = words(50), words(45), words(200)
    docs = {k: words(200) for k in range(20)}
    for k in (2, 5, 11):
        docs[k][30:30] = shared
    for k in (3, 6):
        docs[k][10:10] = short
    docs[30], docs[31] = near, edited(rng, near, 3)  # 15 of some 196 shingles differ on each side
    docs[32] = edited(rng, near, 40)  # too far
    docs[40] = docs[41] = docs[42] = words(60)
    docs[43] = docs[44] = words(20)
    rows = [(k, " ".join(ws)) for k, ws in docs.items()] + [(40, " ".join(docs[40])), (None, " ".join(docs[40])), (90, None), (91, "")]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {i for r in found for i in (r.doc_id, r.class_id)} == {2, 5, 11, 30, 31, 40, 41, 42}
    for r in found:
        a, b = (set(zip(*[docs[i][s : s + n][k:] for k in range(5)], strict=False)) for i, s, n in ((r.doc_id, r.start, r.n_words), (r.class_id, r.class_start, r.class_words)))
        assert r.similarity == pytest.approx(len(a & b) / len(a | b)) and r.similarity >= 0.8
    assert {(r.doc_id, r.class_id) for r in found if r.doc_id in (40, 41, 42)} == {(40, 40), (41, 40), (42, 40)}
    assert passages.repeated_passages(awkward(spark).limit(0)).count() == 0


def longest_like(x, y):
    """Words of the shorter side of the longest parts that are similar enough, by trying all of them."""
    best = 0
    ends = sorted({0, len(x)} | {k for k in range(1, len(x)) if (x[k] in y) != (x[k - 1] in y)})
    for s in ends:
        for e in ends:
            if e - s >= 46:
                a, b = set(x[s:e]), set(y[s:e])
                best = max(best, (len(a & b) >= 0.8 * len(a | b)) * (e - s + 4))
    return best


@pytest.mark.parametrize("around", [0, 70])
def test_edits_at_even_spacing_leave_a_passage(around):
    rng = random.Random(7)
    for n in range(60, 261, 9):
        for edits in range(1, 6):
            a = prose(rng, n).split()
            b = list(a)
            for k in range(edits):
                b[(k + 1) * n // (edits + 1)] = f"edit{rng.randrange(10**6)}"
            texts = [" ".join([f"{side}{k}" for k in range(around)] + ws + [f"{side}{k}" for k in range(around)]) for side, ws in (("a", a), ("b", b))]
            x, y = map(passages.shingles, texts)
            found = list(passages.verify(x, y))
            assert max((min(e - s, q - p) + 4 for s, e, p, q, _ in found), default=0) >= longest_like(x.tolist(), y.tolist()), (n, edits)
            assert all(min(e - s, q - p) >= passages.T and like >= 0.8 for s, e, p, q, like in found)


def test_near_copies_with_short_pieces_have_rows(spark):
    rng = random.Random(17)
    rows, whole = [], []
    for k, (n, places) in enumerate([(79, [39]), (131, [43, 87]), (257, [43, 86, 129, 172, 215]), (148, [104])]):
        a = prose(rng, n).split()
        b = list(a)
        for p in places:
            b[p] = f"edit{p}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        whole.append((2 * k, 2 * k + 1, n))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(min(r.doc_id, r.class_id), max(r.doc_id, r.class_id)) for r in found if r.doc_id != r.class_id}
    assert pairs == {(a, b) for a, b, _ in whole}


def test_form_letters_with_the_same_filling_meet(spark):
    rng = random.Random(23)
    form = prose(rng, 68).split()

    def letter(k, one, two):
        notice = [*form[:22], one, *form[22:45], two, *form[45:]]
        return " ".join([f"a{k}x{i}" for i in range(15)] + notice + [f"z{k}x{i}" for i in range(15)])

    fillings = [(f"name{k}", f"day{k}") for k in range(300)]
    rows = [(k, letter(k, *filling)) for k, filling in enumerate(fillings)] + [(1000 + k, letter(1000 + k, *fillings[k])) for k in range(0, 300, 10)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {r.doc_id for r in found if r.n_words >= 70 and r.class_id != r.doc_id} | {r.class_id for r in found if r.n_words >= 70 and r.class_id != r.doc_id}
    assert {k for k in range(0, 300, 10)} | {1000 + k for k in range(0, 300, 10)} <= whole


def test_near_copies_that_are_no_stars_meet(spark):
    """Letters of one form are too unlike each other, but two with the same fillings differ in one word in the middle and share no 50 words."""
    rng = random.Random(31)
    form = prose(rng, 98).split()

    def letter(k, filling, edit):
        notice = list(form)
        for place in range(9, 98, 20):
            notice[place] = f"{filling}at{place}"
        notice[49] = edit or notice[49]
        return " ".join([f"a{k}x{i}" for i in range(15)] + notice + [f"z{k}x{i}" for i in range(15)])

    rows = [(k, letter(k, f"name{k}", None)) for k in range(100)] + [(1000 + k, letter(1000 + k, f"name{k}", f"edit{k}")) for k in range(0, 100, 8)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(min(r.doc_id, r.class_id), max(r.doc_id, r.class_id)) for r in found if r.doc_id != r.class_id and r.n_words >= 90}
    assert pairs == {(k, 1000 + k) for k in range(0, 100, 8)}


def test_near_copies_of_a_key_are_joined_by_as_few_pairs():
    """60 near copies and 60 stretches that are like none: the copies become one class by 59 of their 1,770 pairs."""
    rng = np.random.default_rng(41)
    base = rng.integers(0, 2**32, 80, np.uint32)
    stretches = []
    for k in range(60):
        stretches += [base.copy(), rng.integers(0, 2**32, 80, np.uint32)]
        stretches[-2][k % 5 * 18] = k
    h = np.arange(120)
    pairs = list(passages._tree(h, np.arange(120), stretches))
    assert len(pairs) == 59 and {k for pair in pairs for k in pair} == set(range(0, 120, 2))
    assert all(next(passages.verify(stretches[i], stretches[j]), None) for i, j in pairs)


def test_windows_of_a_key_are_joined_as_all_pairs_would_join_them():
    """Copies with a few edited words, some far from the key's places: no pair of one class less and none more than by comparing all."""
    rng = np.random.default_rng(47)
    bases = rng.integers(1, 2**32, (3, 88), np.uint32)
    stretches, second = [], 30
    for k in range(120):
        own = bases[k % 3].copy()
        for at in rng.choice(np.r_[0:23, 29:53, 59:83], rng.integers(0, 4), replace=False):
            own[at : at + 5] = rng.integers(1, 2**32, 5)
        own[[28, 28 + second]] = bases[0, [28, 28 + second]]
        stretches.append(own)
    h, pos = np.arange(120), np.full(120, 20 << 18 | 10 << 12 | 12 << 6 | 12 + second)

    def root(of, k):
        while of[k] != k:
            k = of[k]
        return k

    want = np.arange(120)
    for i in range(120):
        for j in range(i):
            if any(s <= 28 and 28 + second < e and p <= 28 and 28 + second < q for s, e, p, q, _ in passages.verify(stretches[i], stretches[j])):
                want[root(want, i)] = root(want, j)
    column = np.empty(120, object)
    column[:] = [x.tobytes() for x in stretches]
    got, (one, two) = np.arange(120), passages.compared(np.zeros(120, int), h, pos, column)
    for i, j in zip(one.tolist(), two.tolist(), strict=True):
        assert root(got, i) != root(got, j)
        got[root(got, i)] = root(got, j)
    classes = lambda of: sorted(sorted(k for k in range(120) if root(of, k) == r) for r in {root(of, k) for k in range(120)})
    assert classes(got) == classes(want) and len(one) < 119


def test_a_line_that_texts_repeat_gives_few_links(spark, monkeypatch):
    """60 texts repeat one line 20 times. Held against each place in four texts, their windows gave 80 links each."""
    rng = random.Random(53)
    line = prose(rng, 27)
    rows = [(k, " ".join([*(f"a{k}x{i}" for i in range(20)), *[line] * 20, *(f"z{k}x{i}" for i in range(20))])) for k in range(60)]
    counts, made = [], passages.candidates

    def counted(linked):
        counts.append(linked.count())
        return made(linked)

    monkeypatch.setattr(passages, "candidates", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    windows = passages.double_windows(passages.windows(df.select(F.xxhash64("text").alias("h"), "text")))
    assert sum(counts) < 3 * windows.count()
    assert {r.doc_id for r in found if r.n_words >= 500} | {r.class_id for r in found if r.class_words >= 500} == set(range(60))


def test_repeating_texts_are_like_only_as_a_whole(spark):
    """Lines of two forms that differ in one word are too unlike, the texts with what stands around them are not."""
    rng = random.Random(59)
    before, after, line = (prose(rng, n).split() for n in (14, 14, 28))
    other = [*line[:10], "other", *line[11:]]
    rows = [(k, " ".join([*before, *(form * 12), *after])) for k, form in enumerate((line, other))]
    x, y = (passages.shingles(t) for _, t in rows)
    assert [r[:4] for r in passages.verify(x, y)] == [(0, len(x), 0, len(y))] and not list(passages.verify(x[100:200], y[100:200]))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in found if r.doc_id != r.class_id} in ({(0, 1)}, {(1, 0)})


def test_windows_of_many_texts_at_once_are_those_of_each():
    rng = random.Random(43)
    texts = [prose(rng, n).encode() for n in (50, 49, 300, 0, 71)] + [b"one two " * 60, prose(rng, 90).encode()]
    found = passages._shingled(texts)
    assert [len(x) for x in found] == [46, 0, 296, 0, 67, 116, 86]
    assert all((x == passages.shingles(t.decode())).all() for x, t in zip(found, texts, strict=True))
    found = [x for x in found if len(x)]
    key, text, a, c, b = passages.starts(found)
    for t, values in enumerate(found):
        want = set()
        for f in range(passages.HASHES):
            for left, middle, right in passages.compact_windows(passages._mixed(values ^ passages._SEEDS[f])):
                want.add((f, max(left, middle - passages.T + 1), middle, min(middle, right - passages.T + 1)))
        own = text == t
        assert set(zip((key[own] & 7).tolist(), a[own].tolist(), c[own].tolist(), b[own].tolist(), strict=True)) == want


def test_a_line_shorter_than_a_passage_pairs_few_texts(spark, monkeypatch):
    """300 texts share a line of 20 words and no passage: 44,850 pairs, of which hardly any may be compared."""
    rng = random.Random(37)
    line = prose(rng, 20)
    rows = [(k, " ".join([*(f"a{k}x{i}" for i in range(60)), line, *(f"z{k}x{i}" for i in range(60))])) for k in range(300)]
    counts, made = [], passages.rest_pairs

    def counted(*args):
        pairs = made(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(passages, "rest_pairs", counted)
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert sum(counts) < 4_485


def test_a_later_place_of_a_passage_is_linked_too(spark):
    rng = random.Random(29)
    texts = []
    for _ in range(12):
        shared = prose(rng, 60)
        texts += [f"{prose(rng, 120)} {shared} {prose(rng, 120)} {shared} {prose(rng, 20)}", f"{prose(rng, 120)} {shared} {prose(rng, 20)}"]
    found = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for k in range(0, 24, 2):
        places = {r.start for r in found if r.doc_id == k} | {r.class_start for r in found if r.class_id == k}
        assert all(any(abs(s - p) <= 5 for s in places) for p in (120, 300)), (k, sorted(places))


def test_a_passage_of_very_many_texts_links_each_once(spark):
    rng = random.Random(9)
    shared = prose(rng, 60)
    rows = [(k, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    linked = passages.links(passages.windows(df.select("h", "text")))
    assert linked.count() < 300 * passages.HASHES * (2 + passages.MORE_ORDERS) * 3
    found = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == set(range(300)) and len(found) <= 2 * 300 * (2 + passages.MORE_ORDERS)


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 2**60, 80, np.uint64), rng.integers(0, 4, 80).astype(np.uint64)):
        found = passages.compact_windows(values, 10)
        for s in range(0, 71):
            for e in range(s + 9, 80):
                own = [(left, c, r) for left, c, r in found if left <= s <= c <= e <= r]
                assert len(own) == 1 and values[own[0][1]] == values[s : e + 1].min()


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_matches(text, items):
    words, found = slow_words(text), set()
    for item, t in items:
        own = slow_words(t)
        for k in range(max(1, len(own) - 9)):
            w = own[k : k + 10]
            found |= {(str(item), s, len(w)) for s in range(len(words) - len(w) + 1) if w and words[s : s + len(w)] == w}
    return len(words), found


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.common.BLOCK_BYTES", 2000)
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([0, 1, 4, 10, 30]))) for k in range(12)] + [(3, prose(rng, 12)), (None, prose(rng, 20)), (50, None), (51, "of of of of of of of of of of of of")]
    texts = [prose(rng, 60) + " " + rng.choice(items)[1] + "! " + prose(rng, 20) if rng.random() < 0.5 else prose(rng, 40) for _ in range(40) if (items := [i for i in items if i[1]] or items)]
    texts += ["OF of " * 12, "of " * 12, items[0][1], None, ""]
    df = awkward(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, names = numbered(df)
    given = rows.select("rid", F.col(names["text"]).alias("text"))
    named = [i for i in items if i[0] is not None]
    for block in (decontaminate.BLOCK_WINDOWS, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        got = decontaminate.contamination(given, bench).join(given, "rid").collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n_words, {(m.item_id, m.start, m.n_words) for m in r.matches}) == slow_matches(r.text, named)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert same_rows(clean.collect(), [r for r in df.collect() if not slow_matches(r.text, named)[1]])
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == df.count()


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y beta z gamma"), (4, "gamma beta"), (5, "alpha")], "rid long, text string")
    bench = spark.createDataFrame([(7, "Alpha, beta gamma")], "item_id long, text string")
    near = {r.rid: [m.exact for m in r.matches] for r in decontaminate.contamination(rows, bench, slop=1).collect()}
    assert near[1] == [True] and near[2] == [False] and near[3] == near[4] == near[5] == []
    with pytest.raises(ValueError):
        decontaminate.contamination(rows, bench, slop=60)
