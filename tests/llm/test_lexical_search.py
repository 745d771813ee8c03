import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from civicframe.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """The contract's rows by scoring every document for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(full), sum(n for _, _, n in full)
    df = Counter(t for _, b, _ in full for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b, n in full:
            m = 25 + (75 * n * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if t in b:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def test_terms():
    for text in ("The É-tude x_Y1\x7fz", "ÀB ß　c", "", "a\x00b", "№5 —"):
        assert [t.encode() for t in terms(text)] == L.terms_of(text.encode())


@pytest.mark.parametrize("seed", range(12))
def test_tree_gives_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = int(rng.integers(1, 400)), 30
    held = rng.random((n_docs, n_terms)) < rng.random(n_terms) ** 2
    ranks, of = np.nonzero(held)
    impacts = rng.integers(0, 6 if seed % 3 == 0 else 1000, len(ranks))
    shard = L.Shard(ranks, of, impacts, n_docs, n_terms)
    grid = np.zeros((n_docs, n_terms), np.int64)
    grid[ranks, of] = impacts
    for k, least in ((1, 1), (10, 1), (10, 700), (1000, 1)):
        asked = rng.choice(n_terms, 7, replace=False)
        weights = rng.integers(0, 9, 7)
        scores = grid[:, asked] @ weights
        order = [r for r in np.lexsort((np.arange(n_docs), -scores)) if scores[r] >= least][:k]
        rank, score = shard.top(asked, weights, k, least)
        assert rank.tolist() == [int(r) for r in order] and score.tolist() == scores[order].tolist()


@pytest.mark.parametrize(("size", "most", "block"), [(1 << 19, 10**6, 5000), (40, 10**6, 3), (7, 0, 2)])
def test_search_is_exact_however_it_is_cut(spark, size, most, block):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(60)] + ["É", "Z9"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, None), (301, ""), (302, "-- \t"), (None, docs[5][1]), (None, "w1 w1"), (7, docs[7][1]), (400, "w2 " * 30_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(6)] + [(6, None), (7, "unknown words"), (0, docs[3][1]), (None, "w59, W1"), (8, "")]
    frame = spark.createDataFrame([(a, b, a, "x") for a, b in docs], "doc_id long, text string, doc long, terms string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in L.search(frame, asked, most_terms=most, size=size, block=block).collect()]
    want = brute(docs, items)
    plain = lambda rows: sorted((str(a), b, d) for a, b, _, d in rows)
    assert plain(got) == plain(want)
    # equal rows may change places, so documents are compared as bags for each item and score
    assert Counter((str(a), str(c), d) for a, _, c, d in got) == Counter((str(a), str(c), d) for a, _, c, d in want)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
    assert L.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_work_is_left_out():
    """Of many documents few leaves are opened."""
    rng = np.random.default_rng(1)
    n_docs = 20_000
    ranks = np.sort(rng.choice(n_docs, 6000, replace=False))
    impacts = rng.integers(1, 10**6, 6000)
    shard = L.Shard(ranks, np.zeros(6000, np.int64), impacts, n_docs, 1)
    opened = []
    real, np_lexsort = L.np.lexsort, L.np.lexsort
    try:
        L.np.lexsort = lambda keys: opened.append(len(keys[0])) or np_lexsort(keys)
        rank, _ = shard.top(np.array([0]), np.array([1]), 10)
    finally:
        L.np.lexsort = real
    assert set(rank) == set(ranks[np.argsort(-impacts)[:10]]) and sum(opened) < 1500
