import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from civicframe.llm import subword_sampling
from civicframe.llm.ngram_join import jaccard_components
from civicframe.llm.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(120):
        words = [f"{'abcdefghijklmnop'[(i * 7 + j) % 16]}{'aeiou'[(i + j * j) % 5]}{'lmnrst'[(i * j) % 6]}{i if j % 3 else ''}" for j in range(60)]
        if i % 6 == 1:
            words[5:5] = ["stupid", "idiot"]
        rows.append((i, " ".join(words), ("en", "de")[i % 2], f"src{i % 5}", 1))
        labels.append((i, 1, int(i % 6 == 1)))
    rows += [(200 + i, rows[i][1], "en", "src1", 1) for i in (0, 2)] + [(300, rows[4][1] + " end", "en", "src1", 1), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == columns
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) <= seen
        if name == "toxicity":
            assert not any(i % 6 == 1 for i in ids if i < 120) and {i for i in range(120) if i % 6 != 1} <= set(ids)
        if name == "exact_dedup":
            assert 0 in ids and 200 not in ids and 202 not in ids and len(ids) == len(set(ids))
        if name == "near_dedup":
            assert 4 in ids and 300 not in ids
            assert all(r.component_id == r.doc_id for r in jaccard_components(out, k=5, num=80).collect())
        docs, seen = spark.createDataFrame(out.collect(), out.schema), set(ids)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert "text" not in final.columns and final.count() == docs.count()


CLASHING = ("gone", "drop_id", "toxicity", "run", "norm", "part", "head", "own_0", "taken_id", "copy", "rep", "component_id", "segmentations", "row_key", "budget")


def test_stages_with_odd_rows_and_clashing_names(spark, folder):
    rows = [(1, "river stone " * 30, "en", "src1", 1), (1, "river stone " * 30, "en", "src1", 1), (2, None, None, None, None), (3, "", "en", "src1", 0), (None, "no identifier at all", "de", "src2", 2), (4, "w" * 50_000, "en", "src3", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        expected = docs.columns if name != "encoding" else [c for c in docs.columns if c != "text"] + ["segmentations_"]
        assert out.columns == expected, name
        got = out.collect()
        assert all(r[c] == f"own {c}" for r in got for c in CLASHING), name
        if name in ("toxicity", "near_dedup", "encoding"):
            assert len(got) == 6, name
        if name == "exact_dedup":
            assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 2, 4]
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_registry():
    names = [k for k in queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "encoding"])
def test_workers_give_memory_back(spark, folder, name):
    kept = dict(spark.sparkContext.environment)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)

        def left(batches):
            for _ in batches:
                pass
            resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
            del (large := [np.ones(3 << 20)])[:]  # freed, it raises what the allocator keeps by default
            before = resident()
            del (blocks := [np.ones(1 << 18) for _ in range(20)])[:]
            yield pd.DataFrame({"mb": [resident() - before], "n": [len(large) + len(blocks)]})

        assert max(r.mb for r in spark.range(1).coalesce(1).mapInPandas(left, "mb double, n long").collect()) < 16
    finally:
        spark.sparkContext.environment.clear()
        spark.sparkContext.environment.update(kept)


def test_encoding_bounds_lattices(spark, folder, monkeypatch):
    asked = {}
    monkeypatch.setattr(subword_sampling, "sample_segmentations", lambda docs, *a, kept=subword_sampling.KEPT, **b: asked.update(kept=kept) or docs)
    corpus_pipeline.encoding(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert asked["kept"] <= 16 << 20
