"""The pair operators against brute force on small fixtures, and their defined edge cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pauta.llm import setjoin
from pauta.llm.cross_split import containments, cross_split_links, cross_split_pairs, cross_split_report
from pauta.llm.near_duplicates import near_duplicate_groups, near_duplicate_links, near_duplicate_pairs
from pauta.llm.wordhash import distinct_per_row, ngrams, word_hashes, words
from pyspark.sql import functions as F

VOCABULARY = [f"w{i}" for i in range(400)]


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def resemblance(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        action = rng.random()
        if action < 0.4:
            w[k] = rng.choice(VOCABULARY)
        elif action < 0.6:
            w.insert(k, rng.choice(VOCABULARY))
        elif action < 0.8:
            del w[k]
        else:
            w = w[k:] + w[:k]
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(28, 200)))
        texts.append(base)
        texts += [edited(rng, base, rng.randint(0, max(1, len(base.split()) // 14))) for _ in range(rng.randint(0, 4))]
    boilerplate = " ".join(rng.choice(VOCABULARY) for _ in range(40))
    texts += [boilerplate + " " + " ".join(rng.choice(VOCABULARY) for _ in range(90)) for _ in range(60)]
    return texts


def test_near_duplicates_against_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, None if i % 3 else "", t) for i, t in enumerate(corpus)], "id bigint, subject string, body string")
    df = df.union(df.where("id % 7 = 0"))  # repeated rows
    got = {tuple(r) for r in near_duplicate_pairs(df).collect()}
    long_enough = [i for i, t in enumerate(corpus) if len(words(t)) >= 30]
    want = {(i, j) for i, j in itertools.combinations(long_enough, 2) if resemblance(corpus[i], corpus[j]) >= 0.5}
    assert len(want) > 50
    assert got == want


def test_groups_cover_the_pairs(spark, corpus):
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(corpus)], "id bigint, subject string, body string")
    pairs = {tuple(r) for r in near_duplicate_pairs(df).collect()}
    group = {r["id"]: r["group_id"] for r in near_duplicate_groups(df).collect()}
    assert set(group) == {x for p in pairs for x in p}
    assert all(group[a] == group[b] for a, b in pairs)
    assert all(g <= i for i, g in group.items())


@pytest.mark.parametrize("copies", [3, 200])
def test_copies_in_both_forms(spark, corpus, copies):
    """All pairs of ids, and the form linear in the copies; the same for classes of any size."""
    text = corpus[0] if len(words(corpus[0])) >= 30 else corpus[1]
    rows = [(i, "", text) for i in range(copies)] + [(1000 + i, "", f"{text} fim{i}") for i in range(3)] + [(2000, "", "curto"), (2001, "", "curto")]
    df = spark.createDataFrame(rows, "id bigint, subject string, body string")
    ids = [r[0] for r in rows if r[0] < 2000]
    assert {tuple(r) for r in near_duplicate_pairs(df).collect()} == set(itertools.combinations(ids, 2))
    links = {(r["class_a"], r["class_b"]) for r in near_duplicate_links(df).collect()}
    assert links == set(itertools.combinations([0, 1000, 1001, 1002], 2))
    groups = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in near_duplicate_groups(df).collect()}
    assert groups == {i: (0 if i < 1000 else i, 0, 3) for i in ids}


def test_an_id_under_two_texts_joins_their_groups(spark):
    one, two = (" ".join(VOCABULARY[k : k + 40]) for k in (0, 200))
    rows = [(1, "", one), (2, "", one), (2, "", two), (5, "", two), (6, "", two + " fim")]
    got = {r["id"]: r["group_id"] for r in near_duplicate_groups(spark.createDataFrame(rows, "id bigint, subject string, body string")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1}


def test_short_copies_take_no_part(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, None, None), (4, "", "")], "id bigint, subject string, body string")
    assert near_duplicate_pairs(df).collect() == []
    assert near_duplicate_pairs(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(1)
    base = [rng.choice(VOCABULARY) for _ in range(60_000)]
    other = base[:]
    other[500:500] = ["novo"] * 20
    rows = [(1, "", " ".join(base)), (2, "", " ".join(other)), (3, "", " ".join(rng.choice(VOCABULARY) for _ in range(60_000)))]
    df = spark.createDataFrame(rows, "id bigint, subject string, body string")
    assert {tuple(r) for r in near_duplicate_pairs(df).collect()} == {(1, 2)}


def test_cross_split_against_brute_force(spark, corpus):
    splits = ["train", " Train ", "TRAIN", "dev", "holdout ", None, "other"]
    rows = [(f"c{i:03d}", splits[i % 7], t, "s", 1) for i, t in enumerate(corpus)] + [("x", "dev", None, None, 2), ("y", "train", "", None, 3)]
    df = spark.createDataFrame(rows, "id string, split string, body string, source string, side int")
    df = df.union(df.limit(20))
    got = {tuple(r) for r in cross_split_pairs(df).collect()}
    kind = {r[0]: (r[1] or "").strip().lower() for r in rows}
    body = {r[0]: r[2] or "" for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(body), 2) if {kind[a], kind[b]} in ({"train", "dev"}, {"train", "holdout"}) and min(len(words(body[a])), len(words(body[b]))) >= 15 and resemblance(body[a], body[b]) >= 0.5}
    assert want and got == want
    report = cross_split_report(df)
    leaked = sum(r["leaked"] for r in report.collect())
    assert leaked == len({x for p in want for x in p if kind[x] in ("dev", "holdout")})
    assert cross_split_pairs(df.limit(0)).collect() == []


def test_copies_across_splits(spark):
    text = " ".join(VOCABULARY[:40])
    rows = [(f"t{i:03d}", "train", text) for i in range(80)] + [("e1", "dev", text), ("e2", "holdout", text)]
    df = spark.createDataFrame(rows, "id string, split string, body string")
    got = {tuple(r) for r in cross_split_pairs(df).collect()}
    assert got == {(e, f"t{i:03d}") for e in ("e1", "e2") for i in range(80)}
    assert [tuple(r) for r in cross_split_links(df).collect()] == [("t000", "e1", 80, 2, 1.0, 1.0)]


def test_an_id_in_both_splits_and_under_two_texts(spark):
    one, two = " ".join(VOCABULARY[:40]), " ".join(VOCABULARY[100:140])
    rows = [("a", "train", one), ("a", "dev", one), ("b", "dev", one), ("b", "dev", two), ("c", "train", two), ("c", "train", one), ("d", "train", one)]
    got = {tuple(r) for r in cross_split_pairs(spark.createDataFrame(rows, "id string, split string, body string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}


def test_containment_of_short_records_in_long_ones(spark):
    rng = random.Random(9)
    long_texts = [[rng.choice(VOCABULARY) for _ in range(600)] for _ in range(20)]
    rows = [(f"t{i}", "train", " ".join(w)) for i, w in enumerate(long_texts)]
    for i, w in enumerate(long_texts):
        part = w[100:160]
        for k in range(i % 8):  # some fall below the share
            part[k * 7 + 3] = f"n{i}x{k}"
        rows.append((f"e{i}", "dev", " ".join(part)))
    sets = {r[0]: grams(r[2]) for r in rows}
    want = {}
    for e in (r[0] for r in rows if r[1] == "dev"):
        best = max(len(sets[e] & sets[t]) / len(sets[e]) for t in sets if t[0] == "t")
        if best >= 0.8:
            want[e] = best
    df = spark.createDataFrame(rows, "id string, split string, body string").withColumn("source", F.lit("s"))
    assert {r["id"]: pytest.approx(r["containment"]) for r in containments(df).collect()} == want
    assert 5 < len(want) < 20
    assert cross_split_pairs(df).collect() == []
    (r,) = cross_split_report(df).collect()
    assert (r["records"], r["leaked"], r["contained"]) == (20, 0, len(want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words_of_batches(texts):
    h, o = word_hashes(texts)
    assert list(np.diff(o)) == [len(words(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for w, x in zip(words(t), h[o[i] : o[i + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_rows_beyond_the_key(monkeypatch):
    import pauta.llm.wordhash as wh

    monkeypatch.setattr(wh, "ROW_BITS", 2)
    g = np.array([5, 5, 9, 5, 7, 7], np.uint64) << np.uint64(50)
    row = np.array([0, 0, 3, 4, 9, 9])
    got = wh.distinct_per_row(g, row)
    assert list(got[1]) == [0, 3, 4, 9]
    assert distinct_per_row(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0].size == 0
    assert ngrams(np.zeros(2, np.uint64), np.array([0, 2]), 3)[0].size == 0


def test_hot_nodes_are_split(spark, corpus, monkeypatch):
    """With every gram frequent, pairs meet one level down the tree and none is lost."""
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(corpus)], "id bigint, subject string, body string")
    want = {tuple(r) for r in near_duplicate_pairs(df).collect()}
    monkeypatch.setattr(setjoin, "HOT", -1000)
    assert {tuple(r) for r in near_duplicate_pairs(df).collect()} == want


def _scattered(rng, words_, low, high, fresh):
    """A copy with single words replaced until the resemblance lies in [low, high); None if it jumps over."""
    w = list(words_)
    base = " ".join(words_)
    while True:
        w[rng.randrange(len(w))] = f"n{next(fresh)}"
        r = resemblance(base, " ".join(w))
        if r < high:
            return " ".join(w) if r >= low else None


def test_pairs_at_the_threshold_are_complete(spark):
    """Pairs just above the threshold, of lengths around the former sample borders (64, 128 five-grams)."""
    rng, fresh = random.Random(11), itertools.count()
    texts = []
    while len(texts) < 2400:
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([64, 66, 67, 68, 69, 72, 130, 132, 134, 300]))]
        other = _scattered(rng, base, 0.5, 0.55, fresh)
        if other:
            cut = other.split()
            texts += [" ".join(base), other if rng.random() < 0.5 else " ".join(cut[rng.randrange(4) :])]
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id bigint, subject string, body string")
    want = {(i, i + 1) for i in range(0, len(texts), 2) if resemblance(texts[i], texts[i + 1]) >= 0.5}
    assert len(want) > 800
    assert {tuple(r) for r in near_duplicate_pairs(df).collect()} == want


@pytest.mark.parametrize("hot", [None, 8])
def test_families_of_many_copies_are_complete(spark, monkeypatch, hot):
    """Families whose shared grams are all frequent, as one node a gram and dealt to cells."""
    rng, fresh = random.Random(3), itertools.count()
    texts = []
    for _ in range(8):
        base = [f"v{rng.randrange(10**6)}" for _ in range(130)]
        texts += [t for t in (_scattered(rng, base, 0.68, 0.73, fresh) for _ in range(60)) if t]
    if hot is not None:
        monkeypatch.setattr(setjoin, "HOT", hot)
    sets = [grams(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 3 * len(sets[i] & sets[j]) >= len(sets[i]) + len(sets[j])}
    assert len(want) > 3000
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id bigint, subject string, body string")
    assert {tuple(r) for r in near_duplicate_pairs(df).collect()} == want
