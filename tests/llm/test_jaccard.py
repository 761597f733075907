import random
import re

import numpy as np
import pytest

from tidesignal.llm import jaccard
from tidesignal.llm.common import Scratch


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [(k, shingles(t, n)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((k, len(s), root(k)) for k, s in sets)


def edited(r, words, k):
    w = list(words)
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 4, 5)])
def test_classes_equal_all_pairs(make_docs, n, num, den):
    r = random.Random(n)
    texts = []
    common = [f"c{k}" for k in range(60)]
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 8, 40, 120, 200]))]
        if g % 3 == 0:
            base += common  # a frequent passage
        texts += [edited(r, base, r.randrange(0, max(2, len(base) // 20))) for _ in range(r.choice([1, 5, 25]))]
    chain = [f"k{k}" for k in range(150)]
    for k in range(40):  # a chain: neighbours are linked, its ends are not
        chain = chain[1:] + [f"n{k}"]
        texts.append(" ".join(chain))
    texts += [None, "", "  \n\t", "one two", "ONE two", "one\ttwo", "three", "x " * 5000, texts[0], texts[0].upper(), "é É é É a b", "é É é É A B"]
    r.shuffle(texts)
    got = jaccard.similarity_classes(make_docs(texts), n, num, den).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)), n, num, den)


def test_empty_table_null_keys_and_repeated_rows(make_docs, spark):
    assert jaccard.similarity_classes(make_docs([]), 4, 85, 100).count() == 0
    t = "a b c d e f g h"
    got = jaccard.similarity_classes(make_docs([(3, t, "s"), (3, t, "s"), (None, t, "s"), (1, t, "s"), (9, None, "s")]), 4, 85, 100).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 5, 1), (3, 5, 1), (None, 5, None), (1, 5, 1), (9, 0, 9)], key=str)
    kept = jaccard.keep_one(make_docs([(3, t, "s"), (1, t, "s"), (9, None, "s"), (4, "other words stand here now", "s")])).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [1, 4, 9]


def test_two_texts_of_one_key(make_docs):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = jaccard.similarity_classes(make_docs([(5, a, "s"), (5, b, "s"), (2, a, "s")]), 4, 85, 100).collect()
    assert (2, 27, 2) in set(map(tuple, got)) and len(got) == 3


def test_links_of_both_texts_of_one_key(make_docs):
    """Each of the two texts of key 1 has a near copy elsewhere; both links count."""
    a, b = [f"a{k}" for k in range(100)], [f"b{k}" for k in range(100)]
    near = lambda w: " ".join([*w[:50], "changed", *w[51:]])
    rows = [(1, " ".join(a), "s"), (1, " ".join(b), "s"), (7, near(a), "s"), (8, near(b), "s"), (9, "nothing like it at all", "s")]
    got = jaccard.similarity_classes(make_docs(rows), 4, 85, 100).collect()
    assert sorted((r[0], r[2]) for r in got) == [(1, 1), (1, 1), (7, 1), (8, 1), (9, 9)]
    rows = [(5, " ".join(a), "s"), (5, " ".join(b), "s"), (2, near(a), "s"), (3, near(b), "s")]
    assert sorted((r[0], r[2]) for r in jaccard.similarity_classes(make_docs(rows), 4, 85, 100).collect()) == [(2, 2), (3, 3), (5, 2), (5, 3)]
    assert sorted(r[0] for r in jaccard.keep_one(make_docs(rows), 4, 85, 100).select("doc_id").collect()) == [2, 3]


def test_sizes_of_signatures_meet(make_docs, monkeypatch):
    """Linked sets on both sides of a width of signatures, whose maps are folded, and unlinked ones beside them."""
    r = random.Random(4)
    texts = []
    for size in (1_000, 8_000):
        base = [f"w{r.randrange(10**6)}" for _ in range(size + 3)]
        texts += [" ".join(base), " ".join([*base, "one", "more", "end"]), " ".join(base[: int(size * 0.88)]), " ".join(base[: int(size * 0.8)])]
    got = jaccard.similarity_classes(make_docs(texts), 4, 85, 100).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)), 4, 85, 100)


def test_filter_has_every_id_and_is_one_bit_a_slot(spark):
    ids = spark.range(0, 40_000, 8)
    bits = jaccard._filter(ids.repartition(8))
    assert len(bits) == (1 << (16 * 5_000).bit_length()) // 8
    assert jaccard._marked(bits, np.arange(0, 40_000, 8)).all()
    assert jaccard._marked(bits, np.arange(1, 40_000, 8)).mean() < 0.08
    none = jaccard._filter(ids.limit(0))
    assert len(none) == (1 << 16) // 8 and not jaccard._marked(none, np.arange(1000)).any()


def test_frequent_shingles_are_the_top_and_about_as_many_as_fit(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 64)
    often = [f"a{k} b c d" for k in range(40) for _ in range(50)]
    seldom = [f"x{k} b c d" for k in range(400) for _ in range(5)]
    find = lambda docs: jaccard.frequent_shingles(docs, "text", 4, Scratch(spark, "test"))
    keys, totals = find(make_docs(often + seldom + [None, ""]).coalesce(1))  # a shingle that a task meets once is not counted there
    assert (totals == 50).sum() == 40 and set(totals) == {5, 50} and len(keys) < 100
    assert (np.diff(keys.astype(object)) > 0).all()
    keys, totals = find(make_docs(often[:500]).repartition(4))
    assert len(keys) == 10 and set(totals) == {50}
    assert len(find(make_docs([]))[0]) == 0
