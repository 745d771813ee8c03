"""Ranked lexical search over shards with dual-sorted wavelet trees.

Documents become postings (term, count) once, in one pass over their texts. A shard is as many consecutive documents as
have SHARD postings, so no shard grows with the input and no key decides where a document goes. In a shard the postings
of a term stand by falling impact, and a wavelet tree over the documents' ranks holds this sequence: a node covers a
range of documents and keeps, for each term, the postings of these documents in their order of impact. So the first
posting of a term in a node is the largest impact below it, and the sum of these over a query's terms bounds every score
below the node; at a leaf, a single document, it is the score. Nodes are opened best first, BATCH at a time, and those
whose bound cannot reach the k-th best score are left, which is exact. A task carries the k-th best score of each query
from shard to shard.

Queries go out in blocks of QUERY_BLOCK, whatever their number; all blocks read the same postings. While the queries have
at most BROADCAST_ROWS different terms, only these are kept in the postings, else all are.

Null texts and texts without a term are no documents for the counts and never found; a query without terms finds nothing.
Repeated rows are documents of their own, repeated queries are answered each. Equal scores go by ascending identifier, null
last; equal rows stand next to each other. Texts of any length are read whole. Extra columns are ignored, whatever
their names. Empty tables give an empty table.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from civicframe.llm.common import BROADCAST_ROWS, shared_dir, table, written

#: Results of a query; a document's share of length in its weight, percent; postings and documents of a shard; queries of a block; nodes opened at once.
TOP, LENGTH_SHARE, SHARD, SHARD_DOCS, QUERY_BLOCK, BATCH = 10, 75, 1 << 19, 1 << 16, 5000, 64
#: Bytes below 128 that are no letter or digit part terms; A to Z become small.
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """doc, n (terms with repeats), terms and counts (of terms in the vocabulary, if there is one) for every row."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if known is None else known.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(words) if keep is None else Counter(w for w in words if w in keep)
                sizes.append(len(words))
                terms.append(list(found))
                counts.append(list(found.values()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "terms", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(count, f"doc {kind}, n bigint, terms array<binary>, counts array<bigint>")


class Shard:
    """Postings of some documents as a wavelet tree: by document along the levels, by term and impact along each."""

    def __init__(self, ranks: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((ranks, -impacts, terms))
        ranks, impacts = ranks[order].astype(np.uint16), impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.height = max(1, (n_docs - 1).bit_length())
        # before[level, i]: how many of the first i postings of a level go to a left child
        self.before = np.zeros((self.height, len(ranks) + 1), np.int32)
        self.impacts = np.zeros((self.height + 1, len(ranks) + 1), np.int64)
        self.impacts[0, :-1] = impacts
        for level in range(self.height):
            child = ranks >> (self.height - 1 - level)
            np.cumsum((child & 1) == 0, out=self.before[level, 1:])
            order = np.argsort(child, kind="stable")
            ranks, impacts = ranks[order], impacts[order]
            self.impacts[level + 1, :-1] = impacts

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and scores of the k best documents among those of at least this score; of equal scores the lower ranks."""
        held = self.starts[terms + 1] > self.starts[terms]
        terms, weights = terms[held], weights[held]
        found_rank, found = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(terms):
            return found_rank, found
        # one row for each open node: level, lowest rank, its span of the level, and of each term in it
        level, low, span = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([[0, self.before.shape[1] - 1]])
        a, b = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        bound = (self.impacts[0, a] * weights).sum(axis=1)
        while len(bound):
            full = len(found) == k
            last, last_rank = (found[-1], found_rank[-1]) if full else (least, 1 << 62)
            alive = np.flatnonzero((bound > last) | (bound == last) & (low < last_rank))
            if not len(alive):
                break
            if len(alive) > BATCH:
                best = np.argpartition(-bound[alive], BATCH)
                now, rest = alive[best[:BATCH]], alive[best[BATCH:]]
            else:
                now, rest = alive, alive[:0]
            # children
            at = level[now, None]
            zero = self.before[at, span[now]]
            za, zb = self.before[at, a[now]] - zero[:, :1], self.before[at, b[now]] - zero[:, :1]
            s = span[now, :1]
            middle = s + (zero[:, 1:] - zero[:, :1])
            left = s + za, s + zb
            right = middle + (a[now] - s) - za, middle + (b[now] - s) - zb
            level_ = np.tile(level[now] + 1, 2)
            low_ = np.r_[low[now], low[now] + (1 << (self.height - 1 - level[now]))]
            span_ = np.r_[np.c_[s, middle], np.c_[middle, span[now, 1:]]]
            a_, b_ = np.r_[left[0], right[0]], np.r_[left[1], right[1]]
            bound_ = (np.where(b_ > a_, self.impacts[level_[:, None], a_], 0) * weights).sum(axis=1)
            leaf = level_ == self.height
            hit = leaf & (bound_ >= least)
            if hit.any():
                found, found_rank = np.r_[found, bound_[hit]], np.r_[found_rank, low_[hit]]
                order = np.lexsort((found_rank, -found))[:k]
                found, found_rank = found[order], found_rank[order]
            inner = ~leaf
            level, low, span = np.r_[level[rest], level_[inner]], np.r_[low[rest], low_[inner]], np.r_[span[rest], span_[inner]]
            a, b, bound = np.r_[a[rest], a_[inner]], np.r_[b[rest], b_[inner]], np.r_[bound[rest], bound_[inner]]
        return found_rank, found


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact_of(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive documents with at most size postings, or a single one."""
    kept, held, rows = [], 0, 0
    for batch in batches:
        ends = np.asarray(batch.column("terms").offsets)[1:].astype(np.int64)
        ends, first = ends - int(batch.column("terms").offsets[0].as_py()), 0
        while first < len(batch):
            base = int(ends[first - 1]) if first else 0
            upto = max(int(np.searchsorted(ends, base + size - held, "right")), first + (not rows))
            upto = min(upto, first + SHARD_DOCS - rows)
            if upto > first:
                kept.append(batch.slice(first, upto - first))
                held, rows = held + int(ends[upto - 1]) - base, rows + upto - first
            if upto < len(batch):
                yield pa.Table.from_batches(kept)
                kept, held, rows = [], 0, 0
            first = upto
    if kept:
        yield pa.Table.from_batches(kept)


def hits(rows: DataFrame, queries: list[tuple[int, list[bytes]]], weights: dict[bytes, int], n_docs: int, n_terms: int, k: int = TOP, size: int = SHARD) -> DataFrame:
    """query, doc, score: the k best documents of every shard for each query (number, terms), less those that k better ones have outdone."""
    spark, names = rows.sparkSession, sorted(weights)
    number = {t: i for i, t in enumerate(names)}
    asked = []
    for q, terms in queries:
        times = Counter(number[t] for t in terms)
        if times:
            asked.append((q, np.array(list(times)), np.array([c * weights[names[t]] for t, c in times.items()], np.int64)))
    shared = spark.sparkContext.broadcast((names, asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        known, best = pa.array(names, pa.binary()), {}
        for part in _shards((b for b in batches if len(b)), size):
            part = part.sort_by([("doc", "ascending")]).combine_chunks()
            lists = part.column("terms").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            counts = part.column("counts").combine_chunks()
            counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
            lengths = np.diff(np.asarray(lists.offsets))
            ranks = np.repeat(np.arange(len(part)), lengths)
            terms = pc.index_in(lists.flatten(), value_set=known)
            of = np.asarray(terms.fill_null(-1)).astype(np.int64)
            tf, n = np.asarray(counts.flatten()), np.asarray(part.column("n"))
            asked_for = of >= 0
            if not asked_for.any():
                continue
            ranks, of, tf = ranks[asked_for], of[asked_for], tf[asked_for]
            shard = Shard(ranks, of, impact_of(tf, n[ranks], n_docs, n_terms), len(part), len(names))
            out_q, out_rank, out_score = [], [], []
            for q, own, weight in asked:
                scores = best.get(q, ())
                least = scores[-1] if len(scores) == k else 1
                rank, score = shard.top(own, weight, k, int(least))
                if len(rank):
                    best[q] = np.sort(np.r_[scores, score].astype(np.int64))[::-1][:k]
                    out_q += [q] * len(rank)
                    out_rank.append(rank)
                    out_score.append(score)
            if out_q:
                docs = part.column("doc").take(pa.array(np.concatenate(out_rank))).combine_chunks()
                docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), docs, pa.array(np.concatenate(out_score))], names=["query", "doc", "score"])

    return rows.mapInArrow(search, f"query bigint, doc {rows.schema['doc'].dataType.simpleString()}, score bigint")


def _vocabulary(items: DataFrame, most: int) -> frozenset[bytes] | None:
    """The queries' terms, or None where they are more."""
    terms: set[bytes] = set()
    for row in items.toLocalIterator():
        terms.update(terms_of(row.text))
        if len(terms) > most:
            return None
    return frozenset(terms)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP, most_terms: int = BROADCAST_ROWS, size: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """item, rank, doc, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").cast("binary").alias("text"))
    kind, doc_kind = asked.schema["item"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    index = written(postings(docs, id_col, text_col, _vocabulary(asked, most_terms)), "postings")
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    path, rows, first = f"{shared_dir(spark)}/hits-{uuid.uuid4().hex}", asked.toLocalIterator(), 0
    schema = f"query bigint, doc {doc_kind}, score bigint, item {kind}"
    spark.createDataFrame([], schema).write.parquet(path)
    while n_docs and (some := list(islice(rows, block))):
        queries = [(first + i, terms_of(r.text)) for i, r in enumerate(some)]
        first += len(some)
        names = sorted({t for _, terms in queries for t in terms})
        if not names:
            continue
        # the terms and numbers of one block of queries
        wanted = spark.createDataFrame([(bytearray(t),) for t in names], "term binary")
        df = index.select(F.explode("terms").alias("term")).join(F.broadcast(wanted), "term").groupBy("term").count().collect()
        weights = dict.fromkeys(names, 0) | {bytes(r.term): weight_of(n_docs, r["count"]) for r in df}
        numbers = spark.createDataFrame([(q, r.item) for (q, _), r in zip(queries, some)], f"query bigint, item {kind}")
        found = hits(index, queries, weights, n_docs, n_terms, k, size).join(F.broadcast(numbers), "query")
        found.select("query", "doc", "score", "item").write.mode("append").parquet(path)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    best = spark.read.schema(schema).parquet(path).withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op11_lexical_search": f"""
        WITH t AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
        q AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
        c AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
            FROM c JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10"""
}
