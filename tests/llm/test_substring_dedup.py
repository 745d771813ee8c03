import collections

import numpy as np
import pytest

from civicframe.llm import substring_dedup as D


def texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{j}" for j in rng.integers(0, 3000, n)]
    passage, short = word(70), word(30)
    docs = []
    for i in range(40):
        body = word(int(rng.integers(20, 200)))
        at = int(rng.integers(0, len(body)))
        if i % 5 == 0:
            body[at:at] = passage
        elif i % 5 == 1:
            body[at:at] = short
        elif i % 5 == 2:
            body[at:at] = [w if j % 35 else "changed" for j, w in enumerate(passage)]
        docs.append((i, " ".join(body)))
    return docs + [(90, docs[3][1] + " " + " ".join(word(60))), (91, docs[3][1] + " " + " ".join(word(60))), (92, docs[0][1]), (93, None), (94, ""), (95, "one two"), (96, " ".join(word(60)) * 1)]


@pytest.mark.parametrize("seed", range(2))
def test_finds_all_long_runs(spark, seed):
    docs = texts(seed)
    words = {i: (t or "").split() for i, t in docs}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - D.WORDS + 1):
            where[tuple(w[j : j + D.WORDS])].add(i)
    expected = {i for ids in where.values() if len(ids) > 1 for i in ids}
    rows = D.repeated_passages(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int")).collect()
    got = {r.doc_id for r in rows}
    near = {i for i in range(40) if i % 5 == 2}
    assert expected <= got and got - expected <= near
    assert all(r.n_words >= D.WORDS and r.similarity >= D.SIMILARITY for r in rows)
    for r in rows:
        if r.similarity == 1 and r.rep_id != r.doc_id and r.doc_id not in near | {0} and r.rep_id not in near:
            assert set(words[r.doc_id][r.start_word : r.start_word + 20]) & set(words[r.rep_id])


def test_windows_are_those_of_the_definition():
    rng = np.random.default_rng(0)
    for n, width in ((30, 5), (64, 8), (9, 9), (4, 5)):
        h = rng.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(1)
        bounds = np.array([0, n // 3, n])
        left, c, right = D.compact_windows(h, bounds, width)
        covered = {(a, b): ci for li, ci, ri in zip(left, c, right) for a in range(li, ci + 1) for b in range(ci, ri + 1)}
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            for a in range(lo, hi):
                for b in range(a + width - 1, hi):
                    assert covered[(a, b)] == a + int(h[a : b + 1].argmin())


def similar(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y))


@pytest.mark.parametrize("seed", range(12))
def test_near_passages_are_those_of_brute_force(seed):
    """Edited passages of 50 to 95 words between other words: a part is found where any is, and none is much longer."""
    rng = np.random.default_rng(seed)
    least = D.WORDS - D.K + 1
    passage = rng.integers(0, 1 << 40, int(rng.integers(50, 95)))
    words = [np.concatenate([rng.integers(0, 1 << 40, 12), passage, rng.integers(0, 1 << 40, 12)]) for _ in range(2)]
    for at in rng.integers(12, 12 + len(passage), seed % 3):
        words[1][at] += 1
    if seed % 4 == 3:
        words[1] = np.insert(words[1], 40, 7)
    a, b = ([hash(tuple(w[i : i + D.K].tolist())) for i in range(len(w) - D.K + 1)] for w in words)
    found = D.matching_parts(np.array(a), np.array(b))
    longest = max((y - x for x in range(len(a)) for y in range(x + least, len(a) + 1) for u in range(max(0, x - 1), min(x + 2, len(b))) for v in range(max(u + least, y - 1), min(y + 1, len(b)) + 1) if similar(a[x:y], b[u:v]) >= D.SIMILARITY), default=0)
    assert bool(found) == bool(longest)
    for x, y, u, v, s in found:
        assert y - x >= least and v - u >= least and s == similar(a[x:y], b[u:v]) >= D.SIMILARITY
    if found:  # brute force may add words of no match at the ends
        assert max(y - x for x, y, *_ in found) >= 0.75 * longest


def test_one_changed_word():
    """60 equal words but the one in the middle: 51 of 61 shingles."""
    a = [f"p{i}" for i in range(60)]
    b = [*a[:30], "changed", *a[31:]]
    assert [(x, y) for x, y, *_ in D.matching_parts(*(np.array([hash(tuple(w[i : i + 5])) for i in range(56)]) for w in (a, b)))] == [(0, 56)]


def word_lists(rng, *sizes):
    return [[f"w{j}" for j in rng.integers(0, 1 << 40, n)] for n in sizes]


@pytest.mark.parametrize("fragment", [20, 30, 40])
def test_a_hub_that_quotes_fragments_hides_no_passage(spark, fragment):
    """Triples: two documents share 60 words, an earlier one has them in fragments that are too short."""
    rng = np.random.default_rng(fragment)
    rows = []
    for i in range(40):
        (passage,) = word_lists(rng, 60)
        early = []
        for at in range(0, 60, fragment):
            early += passage[at : at + fragment] + word_lists(rng, 15)[0]
        rows.append((i, " ".join(early)))
        for j in (1, 2):
            before, after = word_lists(rng, 30, 30)
            rows.append((100 * j + i, " ".join(before + passage + after)))
    found = D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {100 * j + i for i in range(40) for j in (1, 2)}
    assert all(r.rep_id % 100 == r.doc_id % 100 and 50 <= r.n_words <= 62 for r in found)


def test_a_line_that_all_share_hides_no_passage(spark):
    """45 words stand in every document; pairs of them share 15 more around them."""
    rng = np.random.default_rng(9)
    (line,) = word_lists(rng, 45)
    rows = []
    for i in range(60):
        left, right = word_lists(rng, 8, 7)
        for j in (0, 1):
            before, after = word_lists(rng, 25, 25)
            shared = left + line + right if i % 3 == 0 else line
            rows.append((2 * i + j, " ".join(before + shared + after)))
    found = D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {2 * i + j for i in range(0, 60, 3) for j in (0, 1)}


def test_recall_of_near_passages(spark):
    """Families of passages with edited words, between other words, against the full comparison of all pairs."""
    rng = np.random.default_rng(4)
    rows, family = [], {}
    for f in range(60):
        (passage,) = word_lists(rng, int(rng.integers(55, 160)))
        for j in range(int(rng.integers(2, 6))):
            words = list(passage)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 45))):
                words[at] = f"edit{rng.integers(0, 1 << 40)}"
            before, after = word_lists(rng, int(rng.integers(5, 60)), int(rng.integers(5, 60)))
            family[len(rows)] = (f, len(before), len(words))
            rows.append((len(rows), " ".join(before + words + after)))
    grams = {i: np.array([hash(tuple(w[j : j + D.K])) for j in range(len(w) - D.K + 1)]) for i, w in ((i, t.split()) for i, t in rows)}
    linked = [(a, b) for a in grams for b in grams if a < b and family[a][0] == family[b][0] and D.matching_parts(grams[b], grams[a])]
    expected = {i for pair in linked for i in pair}
    found = {r.doc_id for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(expected) > 100 and found <= expected and len(found) >= 0.95 * len(expected)


def test_repeated_identifiers_and_other_columns(spark):
    rng = np.random.default_rng(2)
    one, two, rest = word_lists(rng, 70, 70, 40)
    rows = [(1, one), (1, one), (1, two), (2, rest + one), (3, two + rest), (4, rest), (5, one)]
    df = spark.createDataFrame([(i, " ".join(w), "x", 1, 2) for i, w in rows], "doc_id long, text string, id string, rep int, hub int")
    found = D.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 5} and {(r.doc_id, r.rep_id) for r in found} >= {(2, 1), (3, 1), (5, 1)}
    assert len(found) == len({tuple(r) for r in found})


def test_places_take_as_many_bits_as_they_need():
    h = np.random.default_rng(0).integers(0, 1 << 62, 500).astype(np.uint64) << np.uint64(1)
    bounds = np.array([0, 500])
    assert D.minima(h, bounds, 46, bits=1)[2].tolist() == D.minima(h, bounds, 46)[2].tolist()


def test_run_keys():
    g = np.random.default_rng(1).integers(0, 1 << 62, 200).astype(np.uint64)
    both = np.concatenate([g, g[20:120], g[:5]])
    keys = D._run_keys(both)
    assert len(keys) == len(both) - D.LEAST + 1 and (keys[200 : 200 + 100 - D.LEAST + 1] == keys[20 : 120 - D.LEAST + 1]).all()
    assert len(np.unique(keys)) == len(keys) - (100 - D.LEAST + 1) and not len(D._run_keys(g[:10]))


def test_empty(spark):
    assert D.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
