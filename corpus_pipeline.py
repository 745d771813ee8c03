"""The corpus pipeline: what leaves it is encoded, clean, free of copies and mixed to target weights.

Every stage but the last returns the columns of its input, whatever their names; texts of any length are
read whole; an empty table stays empty. What null texts, ties and repeated rows give stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicframe.llm.common import lean_workers, table, written
from civicframe.llm.exact_dedup import distinct_texts
from civicframe.llm.mixing import mixed
from civicframe.llm.ngram_join import one_of_each
from civicframe.llm.subword_sampling import encoded
from civicframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are scored 0.5 or more.

    Null and empty texts have no word that marks the label and stay; repeated rows stay or go together.
    """
    lean_workers(spark)
    return drop_toxic(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays.

    Null counts as empty, so of null, empty and white-space texts one stays for each normal form; of rows that share
    identifier and text one stays; a null identifier is the largest.
    """
    return distinct_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 the one with the smallest identifier stays.

    Texts without words link with nothing and stay; rows that share an identifier are one document and stay or go together.
    """
    lean_workers(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by the target weights; a document appears once for every epoch that takes it.

    Null languages and sources are a leaf of their own; null texts have no tokens; rows that share an identifier are
    taken equally often; equal places in the order go by identifier.
    """
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations in place of the text.

    Null and empty texts get the one empty segmentation; repeated rows get equal ones; a column that is named
    segmentations already stays, and ours has a _ behind its name.
    """
    lean_workers(spark)
    return encoded(docs)


STAGES = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding),
]
#: Toxicity scoring and sampled segmentations have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
