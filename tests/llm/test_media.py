import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from civicframe.llm import media as M


def wav(data=b"\x80" * 64):
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


@pytest.mark.parametrize("data,kind", [(wav(), "audio/wav"), (png(), "image/png"), (GIF, "image/gif"), (BMP, "image/bmp"), (gzip.compress(b"x" * 100), "application/gzip")])
def test_types_and_carving(data, kind):
    top, inside = M.sniff(data)
    assert top[0] == kind and top[1] == len(data) and not inside
    _, inside = M.sniff(b"junk BM RIFF " + data + b" tail")
    assert inside == [(kind, 13, len(data))]


def test_broken_structure_is_ignored():
    for bad in (b"RIFF" + b"\xff" * 60, png()[:-6], b"BM" + b"\0" * 60, b"\x1f\x8b\x08" + b"\0" * 30, b"", b"plain"):
        assert M.sniff(bad) == (None, [])


def test_places_are_found_once():
    data = b"..a..b..a....b"
    find = M.Finder(data)
    for what, at in ((b"a", 0), (b"a", 3), (b"b", 6), (b"b", 1), (b"a", 9), (b"a", 2), (b"zz", 0), (b"zz", 5)):
        assert find(what, at) == data.find(what, at)


@pytest.mark.parametrize("unit", [b"%PDF-1.4 ", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"BM"])
def test_many_hits_take_linear_time(unit):
    began = time.process_time()
    assert M.sniff(unit * 200_000) == (None, [])
    assert time.process_time() - began < 6


def test_pdf_and_zip_ends():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", "text")
    pdf = b"%PDF-1.4\n1 0 obj <<>> endobj\n%%EOF"
    data = b"x" + pdf + b" %PDF- " + pdf + buffer.getvalue() + b"%PDF-"
    assert M.sniff(data)[1] == [("application/pdf", 1, len(pdf)), ("application/pdf", 1 + len(pdf) + 1, len(pdf) + 6), ("application/zip", 1 + 2 * len(pdf) + 7, len(buffer.getvalue()))]


def test_the_query(spark, tmp_path):
    """Every column of the query against plain Python."""
    texts = [(1, "héllo"), (2, None), (3, "x" * 64), (4, "RIFF BM GIF89a"), (5, "y" * 300_001), (6, "héllo"), (6, "héllo"), (7, ""), (8, "z" * 65)]
    spark.createDataFrame([(i, t, "own") for i, t in texts], "doc_id long, text string, sniffed string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = M.op9_media_columns(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    for r in rows:
        plain = (dict(texts)[r.doc_id] or "").encode()
        payload = plain + b"\0" * (max(64, -(-len(plain) // 64) * 64) - len(plain))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(plain), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(wav(payload)), hashlib.sha256(wav(payload)).hexdigest())
        assert r.media_type == "audio/wav" and r.feature.startswith(f"audio/wav;bytes={len(payload)};")
    df = spark.createDataFrame([(b"x", "t", 1)], "m binary, d string, sniffed int")
    assert M.sniffed(df, "m", "d").columns == ["m", "d", "sniffed", "sniffed_"] and M.sniffed(df.limit(0), "m", "d").count() == 0


def test_query_digests(spark):
    texts = [(1, "héllo"), (2, None), (3, "x" * 64), (4, "RIFF BM GIF89a"), (5, "y" * 300_001), (6, "héllo")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    raw = df.select("doc_id", M.stored_wav(M.padded(F.col("text"))).alias("media"), F.lit("audio/wav").alias("d"))
    got = {r.doc_id: r for r in M.sniffed(raw, "media", "d").withColumn("payload", M.carved(F.col("media"), F.col("sniffed.data_start"), F.col("sniffed.data_length"))).collect()}
    for i, t in texts:
        plain = (t or "").encode()
        expected = plain + b"\0" * (max(64, -(-len(plain) // 64) * 64) - len(plain))
        assert bytes(got[i].payload) == expected and bytes(got[i].media) == wav(expected) and got[i].sniffed.declared_ok
        assert hashlib.sha256(bytes(got[i].media)).hexdigest() == hashlib.sha256(wav(expected)).hexdigest()
    assert got[1].sniffed.feature == got[6].sniffed.feature
    nothing = spark.createDataFrame([(None, "x")], "media binary, d string")
    row = M.sniffed(nothing, "media", "d").first().sniffed
    assert row.type is None and row.embedded == [] and row.feature == "unknown"
