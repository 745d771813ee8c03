import hashlib
import random
import zlib

import pytest

from civicframe.llm import periodic_runs as P

DATA = "/root/testdata/sf0.001"


def brute(words, least=P.LEAST, times=P.TIMES):
    """All runs by definition: every period, every longest stretch, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # periods ascend
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The contract's row, step by step."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(), n)


def test_gram_size_is_the_least_overlap():
    assert P.gram_size() == 16 and P.gram_size(4, 2) == 2 and P.gram_size(10, 3) == 7


@pytest.mark.parametrize("seed", range(60))
def test_random_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.randrange(20, 700):
        kind = rng.random()
        if kind < 0.45:
            base = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
            words += base * rng.randrange(1, 9) + base[: rng.randrange(len(base))]
        elif kind < 0.7 and words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randrange(60)]
        else:
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
    assert P.runs_of(words) == brute(words)
    assert P.runs_of(words, 6, 2) == brute(words, 6, 2)


def test_borders_of_length_and_period():
    other = [f"x{i}" for i in range(40)]
    assert P.runs_of(other + ["a"] * 23 + other) == [] and P.runs_of(other + ["a"] * 24 + ["b"]) == [(40, 24, 1)]
    eight, nine = list("abcdefgh"), list("abcdefghi")
    assert P.runs_of(other + eight * 3) == [(40, 24, 8)] and P.runs_of(nine * 3 + other) == [(0, 27, 9)] and P.runs_of((nine * 3)[:-1] + other) == []
    assert P.runs_of(["a"] * 5000) == [(0, 5000, 1)]
    long = [f"w{i}" for i in range(3000)]
    assert P.runs_of(other + long * 3) == [(40, 9000, 3000)] and P.runs_of(long * 2 + other) == []


def test_collapsed_keeps_a_period():
    words = "x a b a b a b a b y".split()
    assert P.collapsed(words, P.runs_of(words, 6, 3)) == "x a b y".split()


def test_query_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in P.op12_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(docs)
    assert got == {d.doc_id: expected(d.doc_id, d.text) for d in docs}
    assert sum(r[1] > 0 for r in got.values()) > len(docs) // 20


def test_odd_rows(spark, tmp_path):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    texts = [None, "", " \t\n", "one", "a b " * 40, "é\x85　b " * 30, "w" * 100_000 + " x" * 50, "  lead  and trail  " * 20]
    rows = [(i, t, i) for i in (plain, planted, None) for t in texts] * 2
    spark.createDataFrame(rows, "doc_id long, text string, periodic long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(i, t)) for i, t, _ in rows)
    from pyspark.sql import functions as F

    clash = P.with_runs(spark.createDataFrame(rows, "doc_id long, text string, periodic long"), F.col("text"))
    assert clash.columns == ["doc_id", "text", "periodic", "periodic_"] and clash.limit(0).count() == 0
    assert P.with_runs(clash.limit(0), F.col("text"), "raw").count() == 0
