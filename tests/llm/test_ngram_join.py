import collections

import numpy as np
import pyarrow as pa
import pytest

from civicframe.llm import ngram_join as N
from civicframe.llm.shingles import shingle_sets


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, k, num, den):
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[vocabulary[j] for j in rng.integers(0, 400, int(rng.integers(3, 120)))] for _ in range(12)]
    passage = [vocabulary[j] for j in rng.integers(0, 400, 30)]
    docs = []
    for i in range(n):
        words = list(bases[int(rng.integers(0, 12))])
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = vocabulary[int(rng.integers(0, 400))]
        if i % 4 == 0:
            words += passage
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else "  ".join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "a b"), (n + 4, "A\nb"), (n + 5, "word " * 30_000)]


@pytest.mark.parametrize("seed,k,num,node", [(0, 4, 85, 4096), (1, 5, 80, 4096), (2, 4, 85, 6)])
def test_components_against_brute_force(spark, monkeypatch, seed, k, num, node):
    monkeypatch.setattr(N, "NODE", node)
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("*", "1 AS n", "2 AS rep")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(df, text_col="body", k=k, num=num).collect()}
    assert got == brute(docs, k, num, 100)


def test_shingles_that_the_sample_misses(spark, monkeypatch):
    """What crowds a block goes last although no sampled document has it; documents without it keep their prefixes, and no link is lost."""
    monkeypatch.setattr(N, "NODE", 20)
    monkeypatch.setattr(N, "HOT_SAMPLE", 0)
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(12)]
    rows = [[*common, *[f"w{i}_{j}" for j in range(60)]] for i in range(80)] + [[f"v{j}" for j in rng.integers(0, 300, 50)] for _ in range(20)]
    rows += [[*r, "more"] for r in rows[::5]]
    docs = [(i, " ".join(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made = {}

    def kept(prefixes, groups):
        made["prefixes"], made["most"] = {r.rep: r.prefix for r in prefixes.collect()}, max(r.c for r in groups.collect())
        return plain(prefixes, groups)

    plain = N.block_members
    monkeypatch.setattr(N, "block_members", kept)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(df).collect()}
    assert got == brute(docs, 4, 85, 100) and made["most"] <= 20
    first = made["prefixes"]
    monkeypatch.setattr(N, "PASSES", 0)
    again = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(df).collect()}
    assert again == got and made["most"] > 60
    # hash order in whole: what has no common shingle is as it was
    assert all(first[i] == made["prefixes"][i] for i in range(80, 100)) and first != made["prefixes"]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, int(rng.integers(5, 200))).astype(np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.05, rng.integers(0, 1 << 62, len(base)).astype(np.uint64), base)))
    n, lead, maps = np.array([len(s) for s in sets]), np.array([s[0] for s in sets]).view(np.int64), [N.bitmap(s) for s in sets]
    found, ways = set(), collections.defaultdict(set)
    for at, tree in N.trees_of(n, lead, maps, list(range(len(sets))), np.zeros(len(sets), int), 85, 100):
        found |= {tuple(sorted((int(at[a]), int(at[b])))) for a, b in tree.pairs(85, 100)}
        place = {int(x): i for i, x in enumerate(at)}
        for a in (int(x) for i, x in enumerate(at) if tree.own[np.flatnonzero(tree.ids == i)[0]]):
            ways[a] |= {int(at[x]) for x in tree.from_one(place[a], 85, 100)}
    links = set()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links.add((b, a))
    assert all(b in ways[a] or a in ways[b] for a, b in links)
    assert links and links <= found and len(found) < 4 * len(links)


def test_sides_give_the_pairs_across():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 90).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.random(90) < 0.95], rng.integers(0, 1 << 62, 3).astype(np.uint64))) for _ in range(50)]
    n, lead, maps = np.array([len(s) for s in sets]), np.array([s[0] for s in sets]).view(np.int64), [N.bitmap(s) for s in sets]
    side = np.arange(50) % 2
    whole, across = set(), set()
    for found, sides in ((whole, side * 0), (across, side)):
        for at, tree in N.trees_of(n, lead, maps, list(range(50)), sides, 85, 100):
            found |= {tuple(sorted((int(at[a]), int(at[b])))) for a, b in tree.pairs(85, 100)}
    assert across and across == {(a, b) for a, b in whole if side[a] != side[b]}


def test_repeated_identifiers(spark):
    """An identifier with several texts joins their components."""
    rng = np.random.default_rng(3)
    one, base = ([f"w{j}" for j in rng.integers(0, 900, 60)] for _ in range(2))
    rows = [(1, one), (2, one), (2, base), (5, [*base, "more"]), (7, one[:20]), (7, one[:20]), (8, base[:9]), (8, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in N.jaccard_components(df).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 1), (5, 1), (7, 7), (7, 7), (8, 8), (8, 8)]
    kept = N.one_of_each(df.selectExpr("*", "1 AS drop_id", "2 AS gone"))
    assert kept.columns == ["doc_id", "text", "drop_id", "gone"] and sorted(r.doc_id for r in kept.collect()) == [1, 7, 7, 8, 8]


def test_shingles_of_blocks(monkeypatch):
    from civicframe.llm import shingles

    texts = pa.array(["x" * 70 + " b c", None, "", "a b  c d e" * 30, " ", "é" * 40, "z"])
    hashes, at = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", 16)
    again, at_again = shingles.word_hashes(texts)
    assert (hashes == again).all() and (at == at_again).all() and at[-1] == len(hashes) == 3 + 121 + 1 + 1
    batch = pa.record_batch([pa.array(range(7)), texts], ["id", "text"])
    parts = list(shingles.by_bytes(batch, 1, 75, 3))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7)) and [p.num_rows for p in parts] == [3, 1, 1, 1, 1]


def test_shingles_of_slices():
    whole = pa.array(["x", "a b c d e", None, "", "A B C D E", "long " * 5])
    sets = shingle_sets(whole.slice(1), 4)
    assert [len(s) for s in sets] == [2, 0, 0, 2, 1] and (sets[0] == sets[3]).all()


def test_stage_and_empty(spark):
    df = spark.createDataFrame(near_copies(3)[:60], "doc_id long, text string")
    kept = sorted(r.doc_id for r in N.one_of_each(df).collect())
    assert kept == sorted({c for _, c in brute(near_copies(3)[:60], 5, 80, 100).values()})
    assert N.jaccard_components(df.limit(0)).count() == 0
