"""Readers, sinks, requests and streams over files written by the tests."""

import hashlib
import io
import json
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from civicframe.operators.joins import CheckFailed
from civicframe.plans.catalog import FILTERS, DatasetQuery, QueryError, level_of, validated
from civicframe.plans.catalog_queries import BUILDERS
from civicframe.sources import readers as R, sinks as K
from civicframe.streaming.months import upsert, upserted


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('x;y\r\n"a;b";"say ""hi"""\r\n ;\r\nshort\r\n"line\nbreak"; 2 \r\n'.encode())
    rows = [tuple(r) for r in R.delimited(spark, str(path), ["x", "y"]).collect()]
    assert rows == [("a;b", 'say "hi"'), ("short", ""), ("line\nbreak", "2")]
    (tmp_path / "b.csv").write_text('x;y\n"open;1\n')
    with pytest.raises(CheckFailed):
        R.delimited(spark, str(tmp_path / "b.csv"), ["x", "y"])
    with pytest.raises(Exception):  # noqa: B017
        R.delimited(spark, str(path), ["y", "x"]).collect()


def test_encodings(spark, tmp_path):
    (tmp_path / "u").write_bytes("﻿città".encode())
    (tmp_path / "w").write_bytes("città €".encode("cp1252"))
    got = {r.e: r.t for r in R.files(spark, str(tmp_path)).select(R.decoded(F.col("content")).alias("d")).select(F.col("d.encoding").alias("e"), F.col("d.text").alias("t")).collect()}
    assert got == {"utf-8": "città", "windows-1252": "città €"}
    assert R.sniffed_separator("a,b,c") == "," and R.sniffed_separator("abc") == "\t"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = zipped(deep__csv=b"9,9\n")
    (tmp_path / "a.zip").write_bytes(zipped(one__csv=b"1,x\n2,y\n3\n", note__txt=b"n", in__zip=inner))
    files = R.files(spark, str(tmp_path))
    members = R.zip_members(files, r"\.csv$")
    assert sorted(r.member for r in members.collect()) == ["deep.csv", "one.csv"]
    rows = R.csv_rows(R.zip_members(files, "^one").select(F.col("content").cast("string").alias("t")), "t", ["a", "b"]).collect()
    assert [(r.a, r.b, r.malformed) for r in rows] == [("1", "x", False), ("2", "y", False), ("3", None, True)]
    data = b"1,x\n2,y\n3\n"
    lock = {"name": "one.csv", "size": len(data), "crc32": zlib.crc32(data), "sha256": hashlib.sha256(data).hexdigest()}
    assert R.zip_members(files, "^one", exactly=1, lock=lock).count() == 1
    for bad in ({"exactly": 2}, {"lock": lock | {"size": 1}}):
        with pytest.raises(Exception, match="match|differ"):
            R.zip_members(files, "^one", **bad).collect()


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="A" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>head</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    }
    (tmp_path / "b.xlsx").write_bytes(zipped(**{k.replace(".", "__"): v for k, v in parts.items()}))
    (row,) = R.workbook_rows(R.files(spark, str(tmp_path)), "A").collect()
    assert (row.sheet, row.row, row.cells) == ("A", 1, {1: "head", 3: "7", 4: "in"})


def test_json_envelopes_and_links(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"d": {"results": [{"a": "1", "b": "2.50"}, {"a": "x", "b": None}]}}))
    assert [tuple(r) for r in R.odata(spark, str(tmp_path / "o.json"), {"a": "int", "b": "decimal(9,2)"}).collect()] == [(1, 2.5), (None, None)]
    objects = spark.createDataFrame([('{"x": {"n": 1}, "y": {"n": 2}}',)], "j string").select(F.explode(R.keyed_objects("j", "n int")).alias("k", "v"))
    assert {r.k: r.v.n for r in objects.collect()} == {"x": 1, "y": 2}
    pages = spark.createDataFrame([('<a href="/f/2023/a.csv">x</a><a href="/f/2024/a.csv">y</a><a href="/z">',)], "h string")
    assert R.page_links(pages, "h", "csv$").agg(F.max_by("link", "year")).first()[0] == "/f/2024/a.csv"


def test_refusals(spark, tmp_path):
    """What a reader must not take."""
    fields = "document string, series string, type string, number string, title string, presented string"
    good = ("u/1", "VIII", "D", "2", "Rendiconto delle entrate e delle spese del Senato per l'anno finanziario 2021", "2022-07-01")
    assert R.registry_documents(spark.createDataFrame([good], fields), "VIII", "D").count() == 1
    for at, value in ((4, "Altro"), (3, " "), (5, "")):
        bad = spark.createDataFrame([tuple(value if i == at else x for i, x in enumerate(good))], fields)
        with pytest.raises(Exception, match="registry"):
            R.registry_documents(bad, "VIII", "D").collect()
    texts = spark.createDataFrame([("b,a\n1,2\n",)], "t string")
    with pytest.raises(Exception, match="columns"):
        R.csv_rows(texts, "t", ["a", "b"], header=True).collect()
    book = spark.createDataFrame([("p", bytearray(zipped(**{"xl/workbook__xml": b"<w/>", "xl/_rels/workbook__xml__rels": b"<r/>"})))], "path string, content binary")
    with pytest.raises(Exception, match="no sheet"):
        R.workbook_rows(book, "Missing").collect()
    with pytest.raises(CheckFailed):
        R.not_empty(texts.limit(0), "dump")
    assert R.not_empty(texts, "dump") is texts


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "t1")], "k int, v string, at string")
    target = str(tmp_path / "t")
    assert K.write_if_changed(df, target, ("at",)) and not K.write_if_changed(df.withColumn("at", F.lit("t2")), target, ("at",))
    assert K.write_if_changed(df.withColumn("v", F.lit("b")), target, ("at",)) and spark.read.parquet(target).first().v == "b"
    with pytest.raises(RuntimeError):
        K.replace_atomically(spark, lambda where: (_ for _ in ()).throw(RuntimeError()), target)
    assert spark.read.parquet(target).first().v == "b"
    K.write_pair(df, {"b": 1, "a": 2}, str(tmp_path / "p"))
    assert (tmp_path / "p" / "meta.json").read_text() == '{"a":2,"b":1}'
    m = spark.createDataFrame([("s", "1", "e")], "source string, last_modified string, etag string")
    assert K.unchanged(m, m) and not K.unchanged(m, m.withColumn("etag", F.lit("f")))


def test_artifacts(spark, tmp_path):
    from civicframe.operators.contracts import Check, always, unique

    df = spark.createDataFrame([(1, 5), (2, 7)], "k int, v int")
    checks = [Check("positive", always(F.col("v") > 0)), Check("unique", unique("k"))]
    path = str(tmp_path / "artifact")
    meta = K.write_artifact(df, path, checks, {"source": "x"})
    assert meta["rows"] == 2 and sorted(K.read_artifact(spark, path, checks).collect()) == [(1, 5), (2, 7)]
    with pytest.raises(CheckFailed, match="positive"):
        K.write_artifact(df.withColumn("v", -F.col("v")), path, checks)
    with pytest.raises(CheckFailed, match="large"):
        K.read_artifact(spark, path, [Check("large", always(F.col("v") > 5))])
    df.withColumn("v", F.col("v") + 1).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(CheckFailed, match="sum"):
        K.read_artifact(spark, path, checks)


def test_requests():
    assert set(BUILDERS) == set(FILTERS)
    bad = [DatasetQuery("x"), DatasetQuery("mef_partecipazioni", year=1), DatasetQuery("ipa_enti", code="a", query="b"), DatasetQuery("openbdap_spesa_stato", month=3), DatasetQuery("ipa_struttura"), DatasetQuery("pnrr_asili", cup="1", region="x")]
    for q in bad:
        with pytest.raises(QueryError):
            validated(q)
    assert DatasetQuery("ipa_enti", limit=900, offset=-2).page == (0, 100)
    assert [level_of(DatasetQuery("mef_irpef_comunale", code=c)) for c in ("01", "001", "001001")] == ["region", "province", "municipality"]


def test_upsert_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "u")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    put = upsert(target, ["k"])
    put(a, 0), put(a, 0), put(spark.createDataFrame([(2, "c"), (2, "a")], "k int, v string"), 1)
    assert sorted(map(tuple, upserted(spark, target).collect())) == [(1, "a"), (2, "c")]
    many = spark.range(500).selectExpr("CAST(id AS INT) AS k", "'x' AS v")
    put(many, 2)
    before = {str(p.relative_to(target)) for p in Path(target).rglob("*.parquet")}
    put(spark.createDataFrame([(7, "new"), (900, "more")], "k int, v string"), 3)
    after = {str(p.relative_to(target)) for p in Path(target).rglob("*.parquet")}
    rows = {r.k: r.v for r in upserted(spark, target).collect()}
    assert rows == {**dict.fromkeys(range(500), "x"), 7: "new", 900: "more"}
    assert len({f.split("/")[0] for f in before - after}) <= 2 and len(before & after) > 40
