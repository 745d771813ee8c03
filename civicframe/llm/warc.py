"""WARC archives: written from pages, read back, and assembled to one nested row for each capture.

Writing: each page gives a transaction of three records, the response, its request and a metadata record with the page's
identifier; the latter two name the response in WARC-Concurrent-To. Of pages with equal payloads (by SHA-256) that with
the smallest identifier is a response, the others are revisits without payload that refer to it; payloads below a least
size are all responses. Records are strings and an archive is a text file whose rows part with the two line ends that
close a record, packed with gzip, so Spark's own writer makes the archives and its reader streams them.

Reading: the reader parts a file at each empty line; the parts of a record are put together by its Content-Length, so a
payload may hold empty lines or whole records of its own. A task holds one record at a time. Lengths and digests are taken
from the bytes that were read; a record that is cut off, longer or shorter than it says, or whose digest is another, has
intact = false.

Assembly: requests and metadata join their response or revisit through concurrent-to identifiers, given on either side,
or over one record between (metadata names the request, the request the response). Captures without request or metadata
have empty lists; side records that name no capture are in no row. Copies of a side record (same identifier) count once.

Null html is an empty payload; a null or odd url is written without its control characters, null without the field. A null
identifier is the largest; of pages with equal identifier, url and payload each gives a row again, and pages that share
the smallest identifier of their group are all responses. Extra columns are ignored, whatever their names. An empty table
gives no archive rows. Payloads of any length are written and read whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from civicframe.llm.common import BROADCAST_ROWS, shared_dir, table, written

#: Of base 32, of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION, PROFILE, END = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "\r\n\r\n"
#: Payloads of at least so many bytes are revisited; the date of captures without one; records of an archive.
LEAST_BYTES, DATE, RECORDS = 0, "2000-01-01T00:00:00Z", 30_000
#: Bytes and rows of a batch that the reader gives on.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 500
RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("refers_to", pa.string()), ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("archive", pa.string()),
])
RECORD_SQL = """record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string, http_head binary,
    payload binary, payload_bytes bigint, payload_digest string, intact boolean, archive string"""
CAPTURES, SIDES = ("response", "revisit", "resource"), ("request", "metadata")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32."""
    digits = F.sha1(payload)
    fives = [F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in fives for j in range(4)])


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.encode(F.concat(F.lit(kind), key), "UTF-8"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _key(page: Column, url: Column, sha: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), url), F.lit("-")), sha)


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the line ends that close it; fields that are null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    head = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\n"), *lines)
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _uri(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "")


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page, url, html (empty for null), sha and head: of its payload's group the page with the smallest identifier, null if the page is in no group."""
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    order = F.struct(F.col("page").isNull().alias("none"), "page", "url")
    groups = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1").select("sha", "head"), "groups")
    small = groups.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(groups) if small else groups, "sha", "left")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, least: int = LEAST_BYTES, per_file: int = RECORDS) -> None:
    """Writes archives of all pages under path."""
    rows = revisits(pages, id_col, url_col, html_col, least)
    again = F.col("head").isNotNull() & ~F.col("head.page").eqNullSafe(F.col("page"))
    rows = rows.select("*", _key(F.col("page"), F.col("url"), F.col("sha")).alias("key"), base32_sha1(F.col("html")).alias("digest"), again.alias("again"))
    when = F.lit(DATE) if date is None else date
    url = ("WARC-Target-URI", _uri(F.col("url")))
    own, stamp = _urn("response", F.col("key")), ("WARC-Date", when)
    head_key = _key(F.col("head.page"), F.col("head.url"), F.col("sha"))
    if_again = lambda c: F.when(F.col("again"), c)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    main = _record(
        F.when(F.col("again"), "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", own), stamp, url, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", if_again(F.lit(PROFILE))),
            ("WARC-Refers-To", if_again(_urn("response", head_key))), ("WARC-Refers-To-Target-URI", if_again(_uri(F.col("head.url")))), ("WARC-Refers-To-Date", if_again(when)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html"))),
    )
    place, host = F.coalesce(F.nullif(F.regexp_extract(_uri(F.col("url")), r"://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")), F.regexp_extract(_uri(F.col("url")), r"://([^/?#]*)", 1)
    side = [stamp, url, ("WARC-Concurrent-To", own)]
    asked = _record(
        F.lit("request"), [("WARC-Record-ID", _urn("request", F.col("key"))), *side, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(place, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END)),
    )
    facts = _record(
        F.lit("metadata"), [("WARC-Record-ID", _urn("metadata", F.col("key"))), *side, ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    records = rows.select(F.explode(F.array(main, asked, facts)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _fields(head: bytes) -> dict[str, list[str]]:
    """Fields of a head by their small names; a line that begins with white space goes on with the one before."""
    out: dict[str, list[str]] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            last[-1] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = out.setdefault(name.strip().lower(), [])
            last.append(value.strip())
    return out


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def parsed(head: dict[str, list[str]], block: bytes, whole: bool, archive: str, payloads: bool = True) -> dict:
    """A row of RECORD."""
    one = lambda name: head.get(name, [None])[0]
    kind, http, payload = one("warc-type"), None, block
    if (one("content-type") or "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = block.partition(END.encode())
    declared = (one("warc-payload-digest") or "").rpartition(":")[2] or None
    size, digest = len(payload), digest_of(payload)
    if kind == "revisit":
        size, digest = _number(_fields(http or b"").get("content-length", [""])[0]), declared
    return {
        "record_id": one("warc-record-id"), "record_type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": head.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"), "http_head": http, "payload": payload if payloads or kind in SIDES else None, "payload_bytes": size, "payload_digest": digest,
        "intact": whole and (declared is None or kind not in CAPTURES or declared.upper() == digest.upper()), "archive": archive,
    }


def records_in(parts: Iterator[tuple[str, bytes]], payloads: bool = True) -> Iterator[dict]:
    """Rows of RECORD from the parts between empty lines of consecutive files; what stands between records is skipped.

    Whether a file ends with the line ends that close its last record cannot be seen from its parts, so both will do.
    """
    end, head, need, at, held = END.encode(), None, 0, None, bytearray()

    def last() -> Iterator[dict]:
        cut = bytes(held).lstrip(b"\r\n")
        if head is not None:
            yield parsed(head, bytes(held[:need]), len(held) >= need and not held[need:].strip(b"\r\n"), at, payloads)
        elif cut.startswith(b"WARC/"):
            yield parsed(_fields(cut.partition(b"\r\n")[2]), b"", False, at, payloads)

    for archive, part in parts:
        if archive != at:
            yield from last()
            head, at = None, archive
            held.clear()
        else:
            held += end
        held += part
        while True:
            if head is None:
                start = len(held) - len(held.lstrip(b"\r\n")) if held[:1] in (b"\r", b"\n") else 0
                stop = held.find(end, start)
                if stop < 0:
                    break
                if held.startswith(b"WARC/", start):
                    head = _fields(bytes(held[start:stop]).partition(b"\r\n")[2])
                    need = _number(head.get("content-length", [""])[0])
                del held[: stop + len(end)]
                if head is None:
                    continue
            if need is not None and len(held) < need + len(end):
                break
            whole, size = need is not None and held[need : need + len(end)] == end, need or 0
            yield parsed(head, bytes(held[:size]), whole, at, payloads)
            del held[:size]
            head = None
    yield from last()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of packed archives; without payloads those of captures are null, with their lengths and digests."""
    files = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((a.as_py(), p.as_py()) for b in batches for a, p in zip(b.column(0), b.column(1)))
        rows, held = [], 0
        for row in records_in(parts, payloads):
            rows.append(row)
            held += len(row["payload"] or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    return files.mapInArrow(read, RECORD_SQL)


def captures(records: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource: its columns, and requests and metadata (record_id, target_uri, block, intact) by identifier."""
    sides = records.filter(F.col("record_type").isin(*SIDES)).dropDuplicates(["record_id"])
    main = records.filter(F.col("record_type").isin(*CAPTURES))
    named = lambda rows, x, y: rows.select(F.col("record_id").alias(x), F.explode("concurrent_to").alias(y)).select("x", "y")
    direct = named(sides, "x", "y").union(named(main, "y", "x"))
    between = direct.select(F.col("x").alias("y"), F.col("y").alias("z"))
    over = direct.join(between, "y").select("x", F.col("z").alias("y"))
    pairs = direct.union(over).distinct()
    side = F.struct("record_id", "target_uri", F.col("payload").alias("block"), F.col("http_head"), "intact")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, side)))
    # the side records of one capture
    joined = sides.join(pairs, F.col("record_id") == F.col("x")).groupBy(F.col("y").alias("capture")).agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    found = main.drop("concurrent_to").join(joined, F.col("record_id") == F.col("capture"), "left").drop("capture")
    none = F.array().cast(joined.schema["requests"].dataType)
    return found.withColumn("requests", F.coalesce("requests", none)).withColumn("metadata", F.coalesce("metadata", none))


def metadata_field(name: str) -> Column:
    """A field of a capture's first metadata record that has it."""
    found = F.transform("metadata", lambda m: F.regexp_extract(m["block"].cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = written(read_archives(spark, path, payloads=False), "records")
    page = metadata_field("page-id").cast(pages.schema["page_id"].dataType)
    found = written(captures(records).select("record_id", page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("original"), "intact"), "captures")
    first = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("original")).agg(F.min("page_id").alias("refers_to"))
    return found.join(first, "original", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = {
    "op13_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
                1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) // CAST(2 ** (15 - 5 * (i % 4)) AS BIGINT)) % 32 AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
        FROM p JOIN f USING (html)"""
}
