"""The entry without the training-data operators."""

import sys

import __spark_entry__ as entry


def test_core_queries_stand_alone(monkeypatch):
    """Whatever is missing for the operators, the other queries are there."""
    for name in [m for m in sys.modules if m.startswith("civicframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "civicframe.llm", None)
    names = set(entry.queries())
    assert len(names) > 140 and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) == names


def test_a_broken_operator_is_no_missing_one(monkeypatch):
    import pytest

    for name in [m for m in sys.modules if m.startswith("civicframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "civicframe.llm.warc", None)
    with pytest.raises(ImportError, match="warc"):
        entry.queries()


def test_every_query_reads_its_folder(spark, tmp_path):
    """No query works on made-up input: without tables each fails when it is built."""
    import pytest

    for name, build in entry.queries().items():
        with pytest.raises(Exception, match=r"PATH_NOT_FOUND|does not exist|FileNotFound"):
            build(spark, str(tmp_path / "nowhere")).count()


def test_every_core_query_has_sql():
    sql = entry.oracle_sql()
    assert all(n in sql for n in entry.queries() if not n.startswith("op") and n != "pipeline")
