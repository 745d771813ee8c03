"""Search for folded terms anywhere in texts, by an inverted index of trigrams.

Every text that has a term has all trigrams of it, so the texts in the lists of some of them hold all hits: none is lost.
The lists of a term's rarest trigrams are intersected, the shortest first, and what is left is verified on the text.
A list stands in buckets of at most about BUCKET_ROWS texts, so that a common trigram is no row that grows with the table.
Terms that fold to fewer than three characters have no trigram; for them texts are scanned.

Null texts and null identifiers are not found. Rows that share an identifier are verified each. Terms that fold to nothing find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicframe.functions.scalars import search_key
from civicframe.sources.shared import shared_folder

#: Texts of a bucket; lists of a term that are intersected.
BUCKET_ROWS, RAREST = 50_000, 3
#: Identifiers in the lists that a task gathers.
GATHERED = 1_000_000


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, bucket and ids of texts (id, key, bucket); whenever the texts have GATHERED identifiers to list, their lists go out."""
    for batch in batches:
        first, found, n = 0, [], 0
        for row, key in enumerate(batch.column("key").to_pylist()):
            # three code points of 21 bits as one number
            points = np.frombuffer(key.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            found.append(np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
            n += len(found[-1])
            if n >= GATHERED or row == batch.num_rows - 1:
                yield _lists(batch, first, found)
                first, found, n = row + 1, [], 0


def _lists(batch: pa.RecordBatch, first: int, found: list[np.ndarray]) -> pa.RecordBatch:
    """The lists of consecutive texts of a batch; found: each one's distinct trigrams."""
    grams, rows = np.concatenate(found), np.repeat(np.arange(first, first + len(found)), [len(f) for f in found])
    buckets = batch.column("bucket").to_numpy()[rows]
    order = np.lexsort((grams, buckets))
    grams, buckets = grams[order], buckets[order]
    starts = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (buckets[1:] != buckets[:-1])]) if len(grams) else np.arange(0)
    points = np.stack([grams[starts] >> 42, grams[starts] >> 21 & 0x1FFFFF, grams[starts] & 0x1FFFFF], axis=1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    ids = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(grams)], pa.int32()), batch.column("id").take(pa.array(rows[order])))
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(buckets[starts]), ids], names=["gram", "bucket", "ids"])


@dataclass
class TrigramIndex:
    texts: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, bucket_rows: int = BUCKET_ROWS) -> TrigramIndex:
        """Stores folded texts and the lists, sorted by trigram within each file."""
        spark = df.sparkSession
        path = shared_folder(spark, "trigrams")
        folded = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), search_key(F.col(text_col)).alias("key"))
        folded.write.parquet(f"{path}/texts")
        texts = spark.read.schema(folded.schema).parquet(f"{path}/texts")
        buckets = max(1, -(-texts.count() // bucket_rows))
        # tasks pass on lists of many texts, where a row for each trigram of each text would be shuffled
        placed = texts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        some = placed.mapInArrow(gathered, f"gram string, bucket bigint, ids array<{dict(texts.dtypes)['id']}>")
        lists = some.groupBy("gram", "bucket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
        lists.sortWithinPartitions("gram", "bucket").write.parquet(f"{path}/lists")
        return cls(texts, spark.read.schema(lists.schema).parquet(f"{path}/lists"))

    def search(self, terms: list[str], rarest: int = RAREST) -> DataFrame:
        """term, id and verified (texts that were looked at for the term) for every text that has a term."""
        spark = self.texts.sparkSession
        asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string").select("term", search_key(F.col("term")).alias("folded"))
        keys = {r.term: r.folded for r in asked.filter("folded <> ''").collect()}
        grams = {t: sorted({k[i : i + 3] for i in range(len(k) - 2)}) for t, k in keys.items()}
        wanted = sorted({g for own in grams.values() for g in own})
        sizes = {r.gram: r.n for r in self.postings.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()} if wanted else {}
        chosen = [(t, keys[t], g) for t, own in grams.items() if own and all(g in sizes for g in own) for g in sorted(own, key=lambda g: (sizes[g], g))[:rarest]]
        need = {t: sum(c[0] == t for c in chosen) for t in keys}
        listed = spark.createDataFrame([(t, k, g, need[t]) for t, k, g in chosen], "term string, folded string, gram string, need int")
        lists = self.postings.filter(F.col("gram").isin(sorted({g for _, _, g in chosen}))).join(F.broadcast(listed), "gram")
        # at most rarest lists of a bucket
        met = lists.groupBy("term", "folded", "need", "bucket").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists")).filter("size(lists) = need")
        both = F.aggregate(F.slice("lists", 2, rarest), F.col("lists")[0]["ids"], lambda a, x: F.array_intersect(a, x["ids"]))
        candidates = met.select("term", "folded", F.explode(both).alias("id"))
        looked = candidates.join(self.texts, "id").select("term", "id", F.contains("key", "folded").alias("hit"))
        short = [(t, k) for t, k in keys.items() if len(k) < 3]
        if short:
            # a few short terms against each text, without a list
            few = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(k).alias("folded")) for t, k in short]))
            looked = looked.unionByName(self.texts.withColumn("x", few).select("x.term", "id", F.contains("key", "x.folded").alias("hit")))
        counts = looked.groupBy("term").agg(F.count(F.lit(1)).alias("verified"))
        # one row for each term
        return looked.filter("hit").join(F.broadcast(counts), "term").select("term", "id", "verified")
