import numpy as np
import pytest

from civicframe.llm import toxicity as X

WORDS = "stone river green table window morning paper garden bridge market yellow silver forest summer winter".split()


def corpus(n=500):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = [WORDS[j] for j in rng.integers(0, len(WORDS), 40)]
        toxic = i % 5 == 1
        if toxic:
            words[int(rng.integers(0, 40))] = ("stupid", "idiot")[i % 2]
            words[int(rng.integers(0, 40))] = f"vequ{WORDS[i % 15]}"
        docs.append((i, " ".join(words), 0))
        labels.append((i, 0, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    extra = [(900, "a stupid idiot vequx", 0), (901, "a 5tup1d !d10t", 0), (902, "i d i o t and s.t.u.p.i.d", 0), (903, "stuuuupid iiidiot", 0), (904, None, 0), (905, "", 0), (906, "river " * 50_000, 0)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, label int")
    return frame, X.learn(frame, spark.createDataFrame(labels + [(904, 1, None)], "doc_id long, quality int, toxic int"))


def test_restores(model):
    lm = model[1]["lm"]
    assert [X.restore(t, lm) for t in ("1d10t", "stuuuupid", "s.t.u.p.i.d", "g4rd3n", "r*ver")] == ["idiot", "stupid", "stupid", "garden", "river"]


def test_scores(spark, model):
    frame, m = model
    got = {r.doc_id: r.toxicity for r in X.score_toxicity(frame, m).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 1) for i in range(500))
    assert all(got[i] >= 0.5 for i in (900, 901, 902, 903)) and got[906] < 0.5 and got[904] == got[905] < 0.5
    assert all(0 <= s <= 1 for s in got.values())


def test_spaces_are_in_the_lattice(spark, model):
    lm = model[1]["lm"]
    assert [X.restore(t, lm) for t in ("a s t u p i d", "r i v e r i d i o t", "$ t u p i d", "s t u p 1 d")] == ["a stupid", "river idiot", "stupid", "stupid"]
    spaced = ["you are a s t u p i d", "r i v e r s t u p i d", "green $ t u p i d.", "s" + "t" * 94 + "upid", "table (s t u p ! d)"]
    clean = ["r i v e r t a b l e", "a b c", "", "w" * 100]
    frame = spark.createDataFrame(list(enumerate(spaced + clean)), "doc_id long, text string")
    got = [r.toxicity >= 0.5 for r in X.score_toxicity(frame, model[1]).orderBy("doc_id").collect()]
    assert got == [True] * len(spaced) + [False] * len(clean)


def test_held_out_recall(spark):
    """The query on the given tables: rows that it has not learnt from."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic").distinct()
    got = X.op3_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.005 * len(clean)


def test_odd_tables(spark, model):
    frame = model[0].filter("doc_id < 20").selectExpr("*", "'own' AS toxicity", "1 AS toxicity__")
    out = X.score_toxicity(frame.union(frame), model[1])
    assert out.columns == ["doc_id", "text", "label", "toxicity", "toxicity__", "toxicity_"] and out.count() == 40
    assert out.select("doc_id", "toxicity_").distinct().count() == 20
    assert X.score_toxicity(frame.limit(0), model[1]).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.learn(docs, none) is None and X.score_toxicity(docs, None).first().toxicity == 0
    assert X.learn(docs.limit(0), none) is None


def readings(token, lm):
    """Score and text of every path through the lattice of a token, one by one."""
    letters, gaps, gap = [], [], False
    for c in token:
        if c.isspace():
            gap = True
            continue
        gaps.append(gap and bool(letters))
        letters.append(c)
        gap = False

    def go(i, a, b, last, score, text):
        if i == len(letters):
            yield score + float(lm[a, b, 0]), text
            return
        c = letters[i]
        starts = [(a, b, last, score, text)]
        if (gaps[i] or c in X.SKIPPED and 0 < i < len(letters) - 1) and b:
            starts.append((b, 0, "", score - X.BORDER + float(lm[a, b, 0]), text + " "))
        options = [(c, 0.0)] if c.isalpha() else [(x, -1.0 if len(X.LEET[c]) == 1 else -1.8) for x in X.LEET.get(c, "")]
        same = lambda j: 0 <= j < len(letters) and letters[j] == c
        again = c.isalpha() and (same(i - 1) and same(i + 1) or same(i - 1) and same(i - 2))
        for a0, b0, last0, s0, t0 in starts:
            for x, cost in options:
                k = X.CODE.get(x, X.N - 1)
                yield from go(i + 1, b0, k, x, s0 + cost + float(lm[a0, b0, k]), t0 + x)
            if again and last0 == c or c in X.SKIPPED or not options:
                yield from go(i + 1, a0, b0, last0, s0 - (0.3 if again or c in X.SKIPPED else 4.0), t0)

    yield from go(0, 0, 0, "", 0.0, "")


def test_restore_is_the_best_of_all_paths():
    import random

    import numpy as np

    rng, words = random.Random(6), np.random.default_rng(6)
    lm = np.log(words.dirichlet(np.full(X.N, 0.3), (X.N, X.N))).clip(-12).astype(np.float32)
    for _ in range(150):
        token = "".join(rng.choices("aabil1!*@0$.-_ x", k=rng.randrange(1, 8))).strip()
        if not token or token.isspace():
            continue
        found = list(readings(token, lm))
        best = max(s for s, _ in found)
        got = X.restore(token, lm)
        assert any(t == got and abs(s - best) < 1e-3 for s, t in found), (token, got)
