"""Periodic runs of words: masked by repeated grams, then found by Main and Lorentz's divide and conquer.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, TIMES * q) that no
neighbouring word extends keeping period q. Shifted by its period a run meets itself in at least

    k = min over q of max(LEAST, TIMES * q) - q

words, so every word of a run lies in a k-gram that its document holds twice; words outside such k-grams cannot
join runs. Only the stretches of words that survive this mask are searched. A stretch is halved again and again:
a run that crosses a centre c holds the words c - q and c, or c and c + q, so each period asks for how far the words
before and after such a pair agree. Names of 2^j-grams, made by doubling, answer this for all pairs of a level at once,
exactly. A text of n words takes O(n) for its mask and a surviving stretch of m words O(m log m) time and
4 m log2(m) bytes for its names.

Null texts have no words, no runs and an empty collapsed text; so have empty texts and those of white space. Texts of
any length are read whole. A null identifier plants nothing. Repeated rows give repeated results, an empty table an
empty table. Other columns stay; if the new column's name is taken it gets a _ behind it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from civicframe.llm.common import free_name, table

#: A run's least length in words, and in periods.
LEAST, TIMES = 24, 3
#: Pairs that are looked at together.
PAIRS = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: binary>"


def gram_size(least: int = LEAST, times: int = TIMES) -> int:
    """The least number of words in which a run meets itself, shifted by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of (w + step)-grams from names of w-grams that begin step words apart."""
    if len(names) <= step:
        return np.empty(0, np.int32)
    return pd.factorize(names[:-step].astype(np.int64) * (int(names.max()) + 1) + names[step:])[0].astype(np.int32)


def _survivors(names: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The longest stretches all of whose words lie in k-grams that occur twice."""
    size = 1
    grams = names
    while 2 * size <= k:
        grams, size = _doubled(grams, size), 2 * size
    if size < k:
        grams = _doubled(grams, k - size)
    if not len(grams):
        return []
    again = np.flatnonzero(np.bincount(grams)[grams] > 1)
    if not len(again):
        return []
    # grams that begin at most k apart touch
    cuts = np.flatnonzero(np.diff(again) > k)
    return [(int(again[a]), int(again[b]) + k) for a, b in zip([0, *(cuts + 1)], [*cuts, len(again) - 1])]


def _agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from i and j on (ahead), or before i and j, are the same; i < j."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    moved = np.zeros(len(i), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        step, names = 1 << power, levels[power]
        may = np.flatnonzero(j + step <= n if ahead else i >= step)
        x, y = (i[may], j[may]) if ahead else (i[may] - step, j[may] - step)
        same = may[names[x] == names[y]]
        moved[same] += step
        i[same] += step if ahead else -step
        j[same] += step if ahead else -step
    return moved


def _stretch_runs(names: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of a stretch, possibly with multiples of their periods."""
    n, levels = len(names), [names]
    while 2 << (len(levels) - 1) <= n:
        levels.append(_doubled(levels[-1], 1 << (len(levels) - 1)))
    # of the words in which a run meets itself, half lie on one side of a pair
    power = min(len(levels) - 1, max(0, ((gram_size(least, times) + 1) // 2).bit_length() - 1))
    size, grams, found, block = 1 << power, levels[power], [], 1
    while block < least:
        block *= 2
    while block // 2 < n:
        periods = np.arange(1, block // times + 1)
        centres = np.arange(block // 2, n, block)
        for first in range(0, len(centres), max(1, PAIRS // len(periods))):
            c = np.repeat(centres[first : first + max(1, PAIRS // len(periods))], len(periods))
            q = np.tile(periods, len(c) // len(periods))
            for i, j in ((c - q, c), (c, c + q)):
                inside = (i >= 0) & (j < n)
                a, b = i[inside], j[inside]
                on = b + size <= n
                near = np.zeros(len(a), bool)
                near[on] = grams[a[on]] == grams[b[on]]
                back = (a >= size) & ~near
                near[back] = grams[a[back] - size] == grams[b[back] - size]
                a, b = a[near], b[near]
                before, after, period = _agree(levels, a, b, False), _agree(levels, a, b, True), b - a
                long = period + before + after >= np.maximum(least, times * period)
                found.append(np.stack([a - before, b + after, period], axis=1)[long])
        block *= 2
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < least:
        return []
    names, found = pd.factorize(np.array(words, dtype=object))[0].astype(np.int32), []
    for low, high in _survivors(names, gram_size(least, times)):
        if high - low >= least:
            found.append(_stretch_runs(names[low:high], least, times) + (low, low, 0))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # a stretch that repeats a period also repeats its multiples: the smallest counts
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
    return sorted(((int(s), int(e - s), int(q)) for s, e, q in rows), key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def with_runs(df: DataFrame, text: Column, out: str = "periodic", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Adds a struct: n_words, runs (start, length, period; by start and period) and the collapsed text."""

    @F.arrow_udf(FOUND)
    def look(texts: pa.Array) -> pa.Array:
        sizes, runs, kept = [], [], []
        for value in texts:
            words = (value.as_py() or b"").split()
            found = runs_of(words, least, times)
            sizes.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            kept.append(b" ".join(collapsed(words, found)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary())], names=["n_words", "runs", "collapsed"])

    (name, raw) = free_name(df, out, "raw")
    found = df.withColumn(raw, look(text.cast("binary")))
    return found.withColumn(name, F.struct(F.col(f"{raw}.n_words"), F.col(f"{raw}.runs"), F.col(f"{raw}.collapsed").cast("string").alias("collapsed"))).drop(raw)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))


@F.arrow_udf(T.BinaryType())
def planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The text, or for one identifier in ten by its hash the text with a period planted from one of its words on."""
    out = []
    for own, value in zip(ids, texts):
        own, value = own.as_py(), value.as_py()
        h = zlib.crc32(own.encode()) if own is not None else 1
        if h % 10 == 0 and (words := (value or b"").split()):
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            tail = words[a : a + p]
            value = b" ".join(words[:a] + (tail * ((len(words) - a) // p + 1))[: len(words) - a])
        out.append(value)
    return pa.array(out, pa.binary())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id").cast("string"), F.col("text").cast("binary")).alias("text"))
    found = with_runs(docs, F.col("text")).select("doc_id", "periodic.*").withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
