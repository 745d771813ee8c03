"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all texts. Tokens that look written around a filter
(symbols or digits for letters, letters repeated, letters spaced out) become a lattice of possible
letters, omissions and, where letters are spaced out, word borders; a Viterbi pass under the
character model restores the likeliest words, and each of them is looked up.
The restored text is scored: a logistic model over words and word beginnings that mark the label,
chosen on at most SAMPLE labelled documents outside fold 0 (those with the smallest xxhash64 of
their identifier), counted over documents that are no near copies of each other, and over the share
of a text's words that have such a mark.

Null and empty texts score the model's prior. Without labels every score is 0. Texts of any length
are scored whole. Rows keep their columns, repeated rows stay repeated, and equal texts get equal
scores; if the new column's name is taken it gets a _ behind it. Of ways to read a token that are
equally likely one counts, always the same: of those with equal ends the one found first, then the one whose end was found
last. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from civicframe.llm.common import bounded_sample, fold_of, free_name, table
from civicframe.llm.language_id import blocks

#: Bound on the labelled documents that the model is fitted on.
SAMPLE = 8000
#: A mark must be this many deviations above its expected number of labelled documents.
SURPRISE = 6.0
BEGINNINGS = (4, 5, 6)
#: Shares of marked words from which a text counts as one kind higher.
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08)
#: The channel: what a symbol may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "*": "aeiou"}
SKIPPED = ".-_'~^"
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
N = len(ALPHABET) + 1  # and one for any other letter
EDGES = ".,;:?!\"'()[]{}<>«»„“”‘’*#%&|~^_-+=/\\"
CODE = {c: i for i, c in enumerate(ALPHABET)}
#: Cost of a word border in a spaced run.
BORDER = 1.0
_SPACED = re.compile(r"(?<![^\s\"'(])(?:[^\W_]|[@$!|+€£*])(?:(?:\s{1,3}|[.\-_*])(?:[^\W_]|[@$!|+€£*])){2,}(?=[\s.,;:?!\"')]|$)")
_ODD = re.compile(r"[0-9@$!|+€£*.\-_'~^]|([^\W\d_])\1\1")
_codes: np.ndarray | None = None
KEPT = 200_000


def code_table() -> np.ndarray:
    global _codes
    if _codes is None:
        _codes = np.fromiter((CODE.get(chr(i).lower()[:1], N - 1 if chr(i).isalpha() else 0) for i in range(0x110000)), np.uint8, 0x110000)
    return _codes


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n over all texts: gram is a number in base N. At most N**3 rows."""

    def count(batches):
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            texts = [t for t in batch.iloc[:, 0] if t]
            for block in blocks(list(range(len(texts))), texts):
                codes = code_table()[np.frombuffer((" " + " ".join(texts[i] for i in block) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
                total += np.bincount((codes[:-2] * N + codes[1:-1]) * N + codes[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int64), "n": total[at]})

    return docs.select(text_col).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Log-probabilities (N, N, N) of the third character, interpolated over orders."""
    three = np.zeros(N**3)
    for gram, n in counts:
        three[gram] = n
    three = three.reshape(N, N, N)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * N)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10)
    return np.log(p3).astype(np.float32)


def restore(token: str, lm: np.ndarray) -> str:
    """The likeliest words behind a token or a spaced run: Viterbi over the lattice of letters and word borders, under the character model."""
    # state: last two codes and the last source letter -> (score, (word so far, its last letter))
    states: dict = {(0, 0, ""): (0.0, None)}
    gaps, letters, gap = [], [], False
    for c in token:
        if c.isspace():
            gap = True
        else:
            gaps.append(gap and bool(letters))
            letters.append(c)
            gap = False
    for i, c in enumerate(letters):
        if gaps[i] or c in SKIPPED and 0 < i < len(letters) - 1:  # a border, or none
            _border(states, lm)
        if c.isalpha():
            options = [(c, 0.0)]
        else:
            options = [(x, -1.0 if len(LEET[c]) == 1 else -1.8) for x in LEET.get(c, "")]
        repeated = c.isalpha() and ((i and letters[i - 1] == c and i + 1 < len(letters) and letters[i + 1] == c) or (i > 1 and letters[i - 1] == c and letters[i - 2] == c))
        after: dict = {}
        for (a, b, last), (score, word) in states.items():
            for x, cost in options:
                k = CODE.get(x, N - 1)
                s = score + cost + float(lm[a, b, k])
                key = (b, k, x)
                if key not in after or after[key][0] < s:
                    after[key] = (s, (word, x))
            if repeated and last == c or c in SKIPPED or not options:
                s = score - (0.3 if repeated or c in SKIPPED else 4.0)
                key = (a, b, last)
                if key not in after or after[key][0] < s:
                    after[key] = (s, word)
        states = after or states
    word = max((s + float(lm[a, b, 0]), i, w) for i, ((a, b, _), (s, w)) in enumerate(states.items()))[2]
    out = []
    while word is not None:
        word, x = word
        out.append(x)
    return "".join(reversed(out))


def _border(states: dict, lm: np.ndarray) -> None:
    """Adds to the states those after a word border."""
    for (a, b, _), (score, word) in list(states.items()):
        if b:
            s, key = score - BORDER + float(lm[a, b, 0]), (b, 0, "")
            if key not in states or states[key][0] < s:
                states[key] = (s, (word, " "))


class Reader:
    """Words and beginnings of texts, restored; what a token gives is kept for up to KEPT tokens."""

    def __init__(self, lm: np.ndarray, marks: dict | None = None):
        self.lm, self.marks, self.seen = lm, marks, {}

    def features(self, token: str) -> tuple:
        word = token.strip(EDGES + " ")
        if token[:1] in LEET and word != token:  # a leading symbol may be a letter: $tupid
            word = token.rstrip(EDGES + " ").lstrip("\"'(")
        if not word or not any(map(str.isalpha, word)):
            return ()
        if not word.isalpha() or _ODD.search(word):
            words = {re.sub(r"[\s.\-_*]", "", word) if re.search(r"\s", word) else word, *restore(word, self.lm).split()}
        else:
            words = (word,)
        out: list = []
        for w in words:
            out.append(w)
            out += [f"{w[:n]}-" for n in BEGINNINGS if len(w) >= n]
        if self.marks is not None:
            return tuple(self.marks[f] for f in out if f in self.marks)
        return tuple(out)

    def tokens(self, text: str) -> Counter:
        """How often each token of a text comes, spaced runs as well as their parts."""
        low = text.lower()
        found = Counter(low.split())
        for run in _SPACED.findall(low):
            found[" ".join(run.split())] += 1
        return found

    def read(self, text: str | None) -> set:
        """Numbers of the text's marks, and after those of all marks the kinds that its share of marked words reaches; without marks, its words and beginnings."""
        out: set = set()
        seen, marked, total = self.seen, 0, 0
        for token, n in self.tokens(text or "").items():
            total += n
            got = seen.get(token)
            if got is None:
                got = self.features(token)
                if len(seen) >= KEPT:
                    seen.clear()
                seen[token] = got
            if got:
                out.update(got)
                marked += n
        if marked and self.marks is not None:
            out.update(len(self.marks) + j for j, share in enumerate(SHARES) if marked >= share * total)
        return out


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, label of at most sample labelled documents outside fold 0; the ids are few, so they are broadcast."""
    known = labels.filter((fold_of() != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = bounded_sample(known, "doc_id", sample)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def fit_marks(rows: list[tuple[int, list[int]]], size: int, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights of the marks and bias: logistic regression by scaled gradient steps; rows are (label, marks that occur)."""
    y = np.array([r[0] for r in rows], float)
    if not len(rows) or y.min() == y.max() or not size:
        return np.zeros(size), (float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -6, 6)) if len(rows) else -6.0)
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.array([k for r in rows for k in r[1]], int)
    weight, bias = np.zeros(size), 0.0
    squares, bias_squares = np.full(size, 1e-6), 1e-6
    for _ in range(steps):
        z = bias + np.bincount(of, weight[at], len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        step = np.bincount(at, g[of], size) + 1e-4 * weight
        squares += step * step
        bias_squares += g.sum() ** 2
        weight -= 0.5 * step / np.sqrt(squares)
        bias -= 0.5 * g.sum() / np.sqrt(bias_squares)
    return weight, float(bias)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Character model from all texts; marks and weights from the labelled sample."""
    spark = docs.sparkSession
    lm = char_model([tuple(r) for r in trigram_counts(docs).collect()])
    shared = spark.sparkContext.broadcast(lm)

    def features(batches):
        reader = Reader(shared.value)
        for batch in batches:
            found = [sorted(reader.read(t)) for t in batch.text]
            # two smallest hashes of word sequences: the same for most near copies
            keys = []
            for t in batch.text:
                h = pd.util.hash_array(np.array(t.lower().split() or [""], dtype=object))
                h = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else h
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(int(mixed.min().astype(np.int64)))
            yield pd.DataFrame({"label": batch.label.astype("int32"), "key": keys, "features": found, "text": batch.text})

    own = _labelled(docs, labels, sample).select("text", "label").mapInPandas(features, "label int, key long, features array<string>, text string")
    single = own.groupBy("label", "key").agg(F.min(F.struct("features", "text")).alias("one")).select("label", "one.*").persist()
    try:
        n, positive = single.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not n:
            return None
        base = (positive or 0) / n
        expected = F.col("n") * base
        marks = (
            single.select("label", F.explode("features").alias("mark"))
            .groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
            .filter((F.col("n") >= 4) & (F.col("hits") >= 0.5 * F.col("n")))
            .withColumn("z", (F.col("hits") - expected) / F.sqrt(expected * (1 - base) + 1e-9))
            .filter(F.col("z") >= SURPRISE)
            .orderBy(F.desc("z"), "mark")
        ).collect()
        names = {r.mark: i for i, r in enumerate(marks)}
        table_of = spark.sparkContext.broadcast(names)

        def hits(batches):
            reader = Reader(shared.value, table_of.value)
            for batch in batches:
                yield pd.DataFrame({"label": batch.label, "at": [sorted(reader.read(t)) for t in batch.text]})

        rows = single.select("label", "text").mapInPandas(hits, "label int, at array<int>").collect()
    finally:
        single.unpersist()
    weight, bias = fit_marks(sorted((r.label, sorted(r["at"])) for r in rows), len(names) + len(SHARES))
    return {"lm": lm, "marks": names, "weight": weight, "bias": bias}


def score_toxicity(docs: DataFrame, model: dict | None, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the column out: a score from 0 to 1."""
    (out,) = free_name(docs, out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # an iterator of batches, so that what a worker has restored serves its next batch
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        reader, weight, bias = Reader(model["lm"], model["marks"]), model["weight"], model["bias"]
        for texts in batches:
            z = [bias + sum(weight[k] for k in sorted(reader.read(t))) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    return docs.withColumn(out, score(F.col(text_col)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, out="score").select(
        "doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is below 0.5, with all their columns and as often as they come.

    Null and empty texts stay unless most labelled documents are toxic; without labels everything stays.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    (score,) = free_name(docs, "toxicity")
    return score_toxicity(docs, model).filter(F.col(score) < 0.5).drop(score)
