import collections
import math
import os

import numpy as np
import pytest

from civicframe.llm import subword_sampling as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def flat():
    return S.load_vocabulary(alpha=0.25)


def every_segmentation(v, text):
    s = S.Sampler(v, 1, 0)
    s.sample([text], [0])
    chunks, out = [s.of[c] for c in s.pattern.findall(" " + text)], {}

    def go(i, pos, log, ids):
        if i == len(chunks):
            out[tuple(ids)] = math.exp(log)
        elif pos == s.lattices.chunk_len[chunks[i]]:
            go(i + 1, 0, log, ids)
        else:
            for e in s.lattices.edges_at(chunks[i], pos):
                go(i, int(s.lattices.end[e]), log + float(s.lattices.log[e]), [*ids, int(s.lattices.piece[e])])

    go(0, 0, 0.0, [])
    return out


def test_frequencies(flat):
    p = every_segmentation(flat, "a bc")
    assert abs(sum(p.values()) - 1) < 1e-6
    n, first, second = 20_000, collections.Counter(), collections.Counter()
    for found in S.Sampler(flat, 3, 1).sample(["a bc"] * n, list(range(n))):
        keys = [tuple(x[0].tolist()) for x in found]
        assert len(set(keys)) == 3
        first[keys[0]] += 1
        second[tuple(keys[:2])] += 1
    for k, x in p.items():
        assert abs(first[k] / n - x) < 5 * math.sqrt(x / n) + 1e-4
    for (a, b), c in second.items():
        x = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - x) < 5 * math.sqrt(x / n) + 3e-4


def test_all_of_a_small_lattice(flat):
    p = every_segmentation(flat, "abc")
    (found,) = S.Sampler(flat, len(p) + 5, 2).sample(["abc"], [7])
    assert {tuple(x[0].tolist()) for x in found} == set(p) and all(x[2] == 1.0 for x in found)
    assert all(abs(math.exp(x[1]) - p[tuple(x[0].tolist())]) < 1e-6 for x in found)


TEXTS = ["", " ", "  a  b ", "naïve 你好 \n\n tab\there 😀", "x" * 3000, "\x00\x01", " lead", "é" * 200, "²². ²", "The quick brown fox. " * 900]


def test_round_trips(flat):
    s = S.Sampler(flat, 3, 5)
    for text, found in zip(TEXTS, s.sample(TEXTS, list(range(len(TEXTS))))):
        assert found and len({tuple(x[0].tolist()) for x in found}) == len(found)
        assert all(S.decode(x[0], flat) == text for x in found)


def test_same_whatever_the_batch(flat):
    alone = [S.Sampler(flat, 2, 5).sample([t], [i])[0] for i, t in enumerate(TEXTS)]
    together = S.Sampler(flat, 2, 5).sample(TEXTS, list(range(len(TEXTS))))
    assert [[x[0].tolist() for x in f] for f in alone] == [[x[0].tolist() for x in f] for f in together]


def test_column(spark):
    df = spark.createDataFrame([(i, t, 1, "own") for i, t in enumerate(TEXTS)] + [(None, None, 1, "own"), (3, TEXTS[3], 1, "own")], "doc_id long, text string, row_key int, segmentations string")
    out = S.decoded(S.sample_segmentations(df, check="good").selectExpr("*", "segmentations_[0].ids AS ids"), "ids")
    assert out.columns == ["doc_id", "text", "row_key", "segmentations", "segmentations_", "good", "ids", "decoded"]
    rows = out.collect()
    assert all(r.decoded == (r.text or "") and r.good and r.segmentations == "own" for r in rows) and len(rows) == len(TEXTS) + 2
    (a, b) = [r.segmentations_ for r in rows if r.doc_id == 3]
    assert a == b
    assert S.sample_segmentations(df.limit(0)).count() == 0 and S.encoded(df.limit(0)).columns == ["doc_id", "row_key", "segmentations", "segmentations_"]


def test_a_wrong_segmentation_is_no_round_trip(flat):
    import pyarrow as pa

    texts = ["one two", "", "three"]
    found = S.Sampler(flat, 2, 5).sample(texts, [1, 2, 3])
    assert S._round_trips(found, pa.array(texts), flat).to_pylist() == [True, True, True]
    found[2][1] = (found[2][1][0][:-1], *found[2][1][1:])
    assert S._round_trips(found, pa.array(texts), flat).to_pylist() == [True, True, False]


WORDS = "a I the of and house it's streets naïve 1984 quickly a\u0301b -- www x".split()


@pytest.mark.parametrize("alpha", [1.0, 0.25, 2.0])
def test_every_segmentation_is_reached(alpha):
    v = S.load_vocabulary(alpha=alpha)
    for i, word in enumerate(WORDS):
        p = {tuple(S.expanded(np.array(k, np.int64), v).tolist()): x for k, x in every_segmentation(v, word).items()}
        assert abs(sum(p.values()) - 1) < 1e-6
        (found,) = S.Sampler(v, len(p) + 1, i).sample([word], [i])
        assert {tuple(x[0].tolist()) for x in found} == set(p) and all(x[2] == 1.0 for x in found)
        assert all(abs(x[1] - math.log(p[tuple(x[0].tolist())])) < 1e-3 for x in found)


def test_inclusion_at_the_production_weights():
    """Sums over samples, each divided by its inclusion, have the expectation of sums over all segmentations."""
    v = S.load_vocabulary()
    p = every_segmentation(v, "house a")
    n, least, total, length = 6000, [], [], []
    for found in S.Sampler(v, 3, 4).sample(["house a"] * n, list(range(n))):
        assert len({tuple(x[0].tolist()) for x in found}) == 3
        part = [(p[tuple(x[0].tolist())], len(x[0]), x[2]) for x in found]
        total.append(sum(x / q for x, _, q in part))
        length.append(sum(x * m / q for x, m, q in part))
        least.append(min(q for *_, q in part))
    assert min(least) < 0.05 and all(0 < q <= 1 for q in least)
    for seen, expected in ((total, 1.0), (length, sum(x * len(k) for k, x in p.items()))):
        assert abs(np.mean(seen) - expected) < 5 * np.std(seen) / math.sqrt(n) + 1e-6


def test_what_a_worker_forgets_changes_nothing(flat, monkeypatch):
    texts = [f"{w} {x} end" for w in WORDS for x in WORDS]
    one = S.Sampler(flat, 2, 5)
    together = [[x[0].tolist() for x in f] for t in texts for f in one.sample([t], [7])]
    monkeypatch.setattr(S, "KEPT", 3000)
    two = S.Sampler(flat, 2, 5)
    apart = [[x[0].tolist() for x in f] for t in texts for f in two.sample([t], [7])]
    assert together == apart and two.lattices.size() < one.lattices.size()
