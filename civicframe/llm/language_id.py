"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are character bigrams and trigrams of the lower-cased text in which every run of
non-letters is one space, hashed to BUCKETS rows of an embedding. A text's vector is the mean of
its subwords' rows over the whole text. The driver trains on at most SAMPLE labelled identifiers (those
with the smallest xxhash64), of each a part of at most CHARS characters from a place that its hash
tells, and on short random excerpts of these; a fifth of the sample is kept from training to fit the
softmax temperature and the score from which a prediction is accepted, near copies on one side.
Inference reduces to a table of per-bucket logits that is broadcast.

Null texts and texts without a letter are `und` with score 0 and not accepted. Without any labelled
row everything is `und`, as in an empty table. Ties go to the first language in alphabetical order.
Texts of any length are read whole. Rows keep all their columns and repeated rows stay repeated; if
the new column's name is taken it gets a _ behind it. Of rows with one identifier the sample has one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from civicframe.llm.common import bounded_sample, fold_of, free_name, table
from civicframe.llm.shingles import shingled, word_hashes

BUCKETS, DIM, SEED = 1 << 15, 16, 7
#: Bounds on the labelled rows that are fetched for training and on the characters of each.
SAMPLE, CHARS = 3000, 20_000
PRECISION = 0.99
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of all texts, and the offset at which each text's begin."""
    codes = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of non-letters stays, as a space
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    keep[ends - np.diff(ends, prepend=0)] = True  # and each text begins with one
    c = np.where(letter, codes, 32)[keep].astype(np.uint32)
    of = text_of[keep]
    two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA6B))
    three = two[:-1] * np.uint32(31) ^ (c[2:] * np.uint32(0xC2B2AE35))
    in2, in3 = of[:-1] == of[1:], of[:-2] == of[2:]
    grams = np.full(2 * len(c), -1, np.int64)
    grams[0 : 2 * len(two) : 2] = np.where(in2, (((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64), -1)
    grams[1 : 2 * len(three) : 2] = np.where(in3, (((three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39)) >> np.uint32(17)).astype(np.int64), -1)
    good = grams >= 0
    owner = np.repeat(of, 2)[good]
    return grams[good], np.searchsorted(owner, np.arange(len(texts) + 1))


def excerpts(text: str, rng: np.random.Generator, n: int = 4) -> list[str]:
    out = [text]
    for size in rng.integers(5, 160, n):
        at = int(rng.integers(0, max(1, len(text) - size)))
        out.append(text[at : at + size])
    return out


def train(texts: list[str], langs: list[str], epochs: int = 6) -> dict | None:
    """The model: languages, logits per bucket (buckets x languages), temperature, threshold."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(SEED)
    label = {x: i for i, x in enumerate(names)}
    examples: list[tuple] = []
    hashes, at = word_hashes(pa.array(texts, pa.large_string()))
    least = [int(shingled(hashes[a:b], 3).min()) if b - a > 2 else i for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]  # near copies mostly share it
    kept = [x % 5 == 0 for x in least]
    for lang in names:
        of = [i for i, x in enumerate(langs) if x == lang]
        if 2 * sum(kept[i] for i in of) > len(of):  # nearly all are copies
            for j, i in enumerate(of):
                kept[i] = j % 5 == 0
    for i, (text, lang) in enumerate(zip(texts, langs)):
        parts = [p for p in excerpts(text, rng) if any(map(str.isalpha, p))]
        if parts:
            grams, at = subwords(parts)
            examples += [(kept[i], label[lang], *np.unique(grams[a:b], return_counts=True)) for a, b in zip(at[:-1], at[1:]) if b > a]
    fit, hold = [e for e in examples if not e[0]], [e for e in examples if e[0]]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), np.float32)
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            _, y, ids, n = fit[j]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ emb[ids]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = np.float32(0.8 * (1 - done / steps))
            back = out @ p
            out -= rate * np.outer(mean, p)
            emb[ids] -= rate * 4 * np.outer(share, back)
            done += 1
    logits = emb @ out
    rows = [(y, (n / n.sum()) @ logits[ids]) for _, y, ids, n in hold or fit]
    y, z = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows]).reshape(len(rows), -1)
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-9)).mean() if len(y) else 0)
    p = softmax(z / temperature)
    top, right = p.max(1) if len(p) else np.zeros(0), p.argmax(1) == y if len(p) else np.zeros(0, bool)
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return {"names": names, "logits": np.ascontiguousarray(logits, np.float32), "temperature": temperature, "threshold": threshold}


def softmax(z: np.ndarray) -> np.ndarray:
    if not z.size:
        return z
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def predict(model: dict | None, texts: list[str | None]) -> pd.DataFrame:
    lang, score, ok = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if model:
        rest = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for block in blocks(rest, texts):
            grams, at = subwords([texts[i] for i in block])
            sums = np.stack([np.add.reduceat(col[grams], at[:-1]) for col in np.ascontiguousarray(model["logits"].T)], 1)
            p = softmax(sums / np.diff(at)[:, None] / model["temperature"])
            best = p.argmax(1)
            for i, b, s in zip(block, best, p[np.arange(len(block)), best]):
                lang[i], score[i] = model["names"][b], min(1.0, float(s))
                ok[i] = s >= model["threshold"]
    return pd.DataFrame({"lang_pred": lang, "score": score, "accepted": ok})


def blocks(index: list[int], texts: list, chars: int = 1_000_000):
    """Runs of texts of about so many characters, so that memory does not depend on the batch."""
    now, size = [], 0
    for i in index:
        now.append(i)
        size += len(texts[i])
        if size >= chars:
            yield now
            now, size = [], 0
    if now:
        yield now


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    """Trains on the labelled rows outside fold 0."""
    known = docs.filter((fold_of(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = F.broadcast(bounded_sample(known.select(F.col(id_col).alias("sample_id")), "sample_id", sample))
    rows = (
        known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .join(chosen, F.col("id") == F.col("sample_id"), "left_semi")
        .withColumn("text", F.substring("text", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.length("text") - CHARS + 1)).cast("int") + 1, F.lit(CHARS)))
        .groupBy("id").agg(F.min(F.struct("lang", "text")).alias("one")).select("id", "one.*")
    ).collect()
    rows.sort(key=lambda r: r.id)
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: dict | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds the struct column out: lang_pred, score, accepted."""
    (out,) = free_name(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def tell(texts: pd.Series) -> pd.DataFrame:
        return predict(shared.value, texts.tolist())

    return docs.withColumn(out, tell(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(id_col) == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.accepted")
