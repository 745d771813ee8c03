import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from civicframe.llm import warc as A

DATA = "/root/testdata/sf0.001"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def assembled(spark, rows, path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, head int").repartition(3)
    A.write_archives(pages, path, **options)
    records = A.written(A.read_archives(spark, path), "records")
    return records, A.captures(records)


def test_base32(spark):
    texts = ["", "a", "é" * 100, "x" * 9999]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(A.base32_sha1(F.col("t"))).collect()
    assert [r[0] for r in got] == [digest(t) for t in texts] == [A.digest_of(t.encode()) for t in texts]


def test_round_trip_of_odd_pages(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = [None, "", "plain", "\r\n\r\n", "a\r\n\r\nb\r\n\r\n", inner, inner * 3, "é\x00\x85　", "\r\r\n\r\n\n", "long " * 200_000, " lead", "trail\r\n"]
    rows = [(i, f"http://h{i}.it/a?b#c" if i % 3 else None, t, "x", i) for i, t in enumerate(texts)]
    rows += [(i + 100, "http://two.it/\r\nInjected: yes x", t, "x", i) for i, t in enumerate(texts)] + [(7, "http://h7.it/a?b#c", texts[7], "x", 1)] * 2 + [(None, None, "plain", "x", 1), (None, "u", "alone", "x", 2)]
    records, found = assembled(spark, rows, str(tmp_path / "w"), per_file=7)
    got = found.withColumn("page", A.metadata_field("page-id").cast("long")).collect()
    assert records.filter("NOT intact").count() == 0 and records.count() == 3 * len(rows) and len(got) == len(rows)
    heads, names = {}, {}
    for i, u, t, *_ in rows:
        if i is not None:
            heads[t or ""] = min(heads.get(t or "", i), i)
    for r in got:
        if r.record_type == "response":
            names[r.record_id] = r.page
    want = sorted((str(i), len((t or "").encode()), digest(t or ""), "response" if i == heads.get(t or "") else "revisit", str(heads.get(t or ""))) for i, u, t, *_ in rows if t != "alone")
    plain = [r for r in got if r.payload != b"alone"]
    assert sorted((str(r.page), r.payload_bytes, r.payload_digest, r.record_type, str(names[r.refers_to] if r.refers_to else r.page)) for r in plain) == want
    texts_of = {i: t for i, _, t, *_ in rows}
    assert all(bytes(r.payload) == (texts_of[r.page] or "").encode() for r in plain if r.record_type == "response")
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 and bytes(r.requests[0].http_head).startswith(b"GET /") for r in got)
    assert not any(b"Injected: yes" in bytes(r.requests[0].http_head).split(b"\r\n") for r in got)


def test_least_size_and_joined_groups(spark, tmp_path):
    rows = [(i, "http://a.it/", "tiny" if i % 2 else "large enough", "x", i) for i in range(10)]
    _, found = assembled(spark, rows, str(tmp_path / "w"), least=5)
    assert found.groupBy("record_type").count().orderBy("record_type").collect() == [("response", 6), ("revisit", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, head int")
    plain = lambda df: sorted(map(str, df.select("page", "head.page").collect()))
    assert plain(A.revisits(pages, "page_id", "url", "html", broadcast_rows=0)) == plain(A.revisits(pages, "page_id", "url", "html"))


def test_records_are_joined_over_either_side(spark, tmp_path):
    def record(kind, own, *to, block=b"", more=b""):
        names = b"".join(b"WARC-Concurrent-To: <%s>\r\n" % t for t in to)
        return b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <%s>\r\n%s%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, own, names, more, len(block), block)

    http = b"Content-Type: application/http; msgtype=response\r\n"
    data = [
        record(b"warcinfo", b"i", block=b"software: x\r\n"),
        record(b"response", b"r1", b"q1", block=b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", more=http), record(b"request", b"q1"), record(b"metadata", b"m1", b"q1", block=b"a: 1\r\nb:\r\n 2\r\n"),
        record(b"response", b"r2", block=b"no head", more=http), record(b"metadata", b"m2", b"r2"), record(b"metadata", b"m3", b"r2"), record(b"metadata", b"m3", b"r2"),
        record(b"resource", b"r3", block=b"raw\r\n\r\n"), record(b"metadata", b"lost", b"nowhere"),
    ]
    (tmp_path / "w").mkdir()
    # one member for each record, then a file that is cut off
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(record(b"response", b"r4", block=b"0123456789")[:-9]))
    wrong = record(b"response", b"r5", block=b"HTTP/1.1 200 OK\r\n\r\nx", more=http + b"WARC-Payload-Digest: sha1:AAAA\r\n")
    (tmp_path / "w" / "c.warc.gz").write_bytes(gzip.compress(wrong + b"noise" + wrong.replace(b"r5", b"r6")))
    records = A.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 12
    got = {r.record_id: r for r in A.captures(records).collect()}
    ids = lambda rows: [r.record_id for r in rows]
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r4>", "<r5>"}
    assert (ids(got["<r1>"].requests), ids(got["<r1>"].metadata), bytes(got["<r1>"].payload)) == (["<q1>"], ["<m1>"], b"body")
    assert (ids(got["<r2>"].requests), ids(got["<r2>"].metadata)) == ([], ["<m2>", "<m3>"]) and bytes(got["<r3>"].payload) == b"raw\r\n\r\n"
    assert [got[f"<r{i}>"].intact for i in range(1, 6)] == [True, True, True, False, False]


def test_parts_of_any_size():
    rng = random.Random(3)
    blocks = ["".join(rng.choices(["\r\n\r\n", "a", "\r\n", "WARC/1.1"], k=rng.randrange(12))) for _ in range(200)]
    text = "".join(f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n" for b in blocks)
    parts = text.encode().split(b"\r\n\r\n")
    parts = parts if parts[-1] else parts[:-1]
    got = list(A.records_in([("e", b"cut"), *(("f", p) for p in parts)]))
    assert [r["payload"].decode() for r in got] == blocks and all(r["intact"] for r in got)


def test_query_agrees_with_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    df = A.op13_warc(spark, DATA)
    rows = df.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, duckdb.sql(A.ORACLE["op13_warc"]).select(*df.columns).fetchall()))


def test_empty_table(spark, tmp_path):
    _, found = assembled(spark, [], str(tmp_path / "w"))
    assert found.count() == 0
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert A.op13_warc(spark, str(tmp_path)).count() == 0
