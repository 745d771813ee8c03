"""Readers over files that are made from the driver's tables: what goes into a file must come out again."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from civicframe.plans.queries import query
from civicframe.plans.roles import read
from civicframe.sources import readers as R

#: Rows of a file.
FILE_ROWS = 400
_ROWS = f"""SELECT CAST(floor(c_custkey / {FILE_ROWS}) AS BIGINT) AS file, CAST(c_custkey AS VARCHAR) AS code, 'say "' || c_name || '", ' || c_nationkey || chr(10) || 'end' AS label FROM customer"""


def _customers(spark, sf_dir) -> DataFrame:
    """file, code and a label with quotes, the separator and a line break; a file has at most FILE_ROWS rows, and there are as many files as it takes."""
    label = F.concat(F.lit('say "'), "c_name", F.lit('", '), F.col("c_nationkey").cast("string"), F.lit("\nend"))
    return read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"), F.col("c_custkey").cast("string").alias("code"), label.alias("label"))


def _as_csv(rows: DataFrame, tail: str = "") -> DataFrame:
    """file and text: the rows of each file, with a header."""
    line = F.concat_ws(",", "code", F.concat(F.lit('"'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('"')))
    lines = rows.groupBy("file").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # FILE_ROWS at most
    return lines.select("file", F.concat(F.lit("code,label\r\n"), F.array_join("lines", "\r\n"), F.lit(tail)).alias("text"))


@query("s01_s02_v02_delimited", f"WITH r AS ({_ROWS}) SELECT code, label, false AS malformed FROM r UNION ALL SELECT 'a', 'b', true FROM (SELECT DISTINCT file FROM r)", roles=False)
def delimited(spark, sf_dir):
    """Quotes, separators and line breaks in cells; a row of another width is marked. Many files, read by as many tasks as there are."""
    return R.csv_rows(_as_csv(_customers(spark, sf_dir), "\r\n\r\na,b,c\r\n").repartition("file"), "text", ["code", "label"], header=True)


_SAID = "CASE i % 4 WHEN 0 THEN 'città ' || n WHEN 1 THEN 'prezzo € ' || n || ' “x”' WHEN 2 THEN 'città ' || n || chr(129) ELSE n END"


@query(
    "s03_s04_encodings",
    f"""WITH t AS (SELECT i, {_SAID} AS text FROM (SELECT p_partkey AS i, p_name AS n FROM part))
        SELECT i, text, CASE i % 4 WHEN 1 THEN CASE WHEN i % 3 = 0 THEN 'utf-8' ELSE 'windows-1252' END WHEN 2 THEN CASE WHEN i % 3 = 0 THEN 'utf-8' ELSE 'iso-8859-1' END
            WHEN 3 THEN 'utf-8' ELSE CASE WHEN i % 3 = 0 THEN 'utf-8' ELSE 'windows-1252' END END AS encoding FROM t""",
    roles=False,
)
def encodings(spark, sf_dir):
    """Names of parts as bytes of three encodings, a third in UTF-8 (every other with a mark), read back by the chain."""
    i, n = F.col("i"), F.col("n")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("n"))
    latin = lambda c: F.encode(c, "ISO-8859-1")
    town = latin(F.concat(F.lit("città "), n))
    price = F.concat(latin(F.lit("prezzo ")), F.unhex(F.lit("80")), latin(F.concat(F.lit(" "), n, F.lit(" "))), F.unhex(F.lit("93")), latin(F.lit("x")), F.unhex(F.lit("94")))
    single = F.when(i % 4 == 0, town).when(i % 4 == 1, price).when(i % 4 == 2, F.concat(town, F.unhex(F.lit("81")))).otherwise(latin(n))
    said = F.when(i % 4 == 0, F.concat(F.lit("città "), n)).when(i % 4 == 1, F.concat(F.lit("prezzo € "), n, F.lit(" “x”"))).when(i % 4 == 2, F.concat(F.lit("città "), n, F.lit("\x81"))).otherwise(n)
    utf8 = F.concat(F.when(i % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b"")), F.encode(said, "UTF-8"))
    files = rows.select("i", F.when(i % 3 == 0, utf8).otherwise(single).alias("content"))
    found = R.decoded(F.col("content"))
    return files.select("i", found["text"].alias("text"), found["encoding"].alias("encoding"))


@query(
    "v03_line_policy",
    """SELECT s_suppkey AS i, s_suppkey % 5 = 1 AS mark, s_suppkey % 5 = 2 AS carriage_returns, s_suppkey % 5 = 3 AS open_end FROM supplier""",
    roles=False,
)
def line_policy(spark, sf_dir):
    """A file for each supplier: strict, with a mark, with carriage returns, with an open last line, or empty."""
    i, name = F.col("s_suppkey"), F.col("s_name")
    lines = F.concat(name, F.lit(";b\nc;d\n"))
    text = F.when(i % 5 == 0, lines).when(i % 5 == 1, F.concat(F.lit("\ufeff"), lines)).when(i % 5 == 2, F.replace(lines, F.lit("\n"), F.lit("\r\n"))).when(i % 5 == 3, F.concat(lines, F.lit("e;f"))).otherwise("")
    return read(spark, sf_dir, "supplier").select(i.alias("i"), R.line_policy(F.encode(text, "UTF-8")).alias("p")).select("i", "p.*")


def _zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _archive(texts: pd.Series) -> pd.Series:
    """An archive with the text as a member, and once more in an archive within it."""
    return pd.Series([_zipped({"data/one.csv": t.encode(), "__MACOSX/x.csv": b"no", "note.txt": b"n", "inner.ZIP": _zipped({"two.csv": t.encode()})}) for t in texts])


@query("s05_s06_s08_archives", f"WITH r AS ({_ROWS}) SELECT m.member, code, label FROM r, (VALUES ('data/one.csv'), ('two.csv')) AS m(member)", roles=False)
def archives(spark, sf_dir):
    """Members by suffix, also within archives, without what a packer adds; an archive for each file."""
    files = _as_csv(_customers(spark, sf_dir)).repartition("file").select(F.concat(F.col("file").cast("string"), F.lit(".zip")).alias("path"), _archive(F.col("text")).alias("content"))
    found = None
    for member in ("data/one.csv", "two.csv"):
        one = R.zip_members(files, rf"{member}$", exactly=1)
        rows = R.csv_rows(one.select(R.decoded(F.col("content"))["text"].alias("text")), "text", ["code", "label"], header=True).filter("NOT malformed")
        rows = rows.select(F.lit(member).alias("member"), "code", "label")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("s07_locked_member", f"""WITH r AS ({_ROWS}) SELECT file, count(*) AS rows, CASE WHEN file % 3 = 0 THEN 'size' WHEN file % 3 = 1 THEN 'sha256' ELSE 'as locked' END AS state
        FROM r GROUP BY file""", roles=False)
def locked_member(spark, sf_dir):
    """The one member of each archive against its lock of name, size, CRC-32 and SHA-256: a third of the locks name another size, a third another digest."""
    texts = _as_csv(_customers(spark, sf_dir)).repartition("file").select("file", F.encode("text", "UTF-8").alias("data"))
    lock = F.struct(
        F.lit("data/one.csv").alias("name"), (F.octet_length("data") + F.when(F.col("file") % 3 == 0, 1).otherwise(0)).cast("bigint").alias("size"), F.crc32("data").alias("crc32"),
        F.when(F.col("file") % 3 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("data", 256)).alias("sha256"),
    )
    packed = texts.select(F.col("file").cast("string").alias("path"), _archive(F.col("data").cast("string")).alias("content"), lock.alias("lock"))
    found = R.member_states(packed, r"^data/").join(texts.select(F.col("file").cast("string").alias("path"), "file", (F.size(F.split(F.decode("data", "UTF-8"), "\r\n")) - 1).cast("bigint").alias("rows")), "path")
    return found.select("file", "rows", "state")


@F.udf(T.BinaryType(), useArrow=False)
def _workbook(text: str) -> bytes:
    """A workbook whose sheet Data has a row for each line: its number, and the line as shared and as inline text."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    lines = text.split("\n")
    cells = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{i}</v></c><c r="B{i + 1}" t="s"><v>{i}</v></c><c r="AA{i + 1}" t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for i, x in enumerate(lines))
    return _zipped({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}>{''.join(f'<si><t>{escape(x)}</t></si>' for x in lines)}</sst>".encode(),
        "xl/worksheets/s.xml": f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>".encode(),
    })


@query("s09_workbook", f"""WITH r AS (SELECT CAST(floor(c_custkey / {FILE_ROWS}) AS BIGINT) AS file, c_name AS name FROM customer)
        SELECT file || '.xlsx' AS path, CAST(row_number() OVER w AS BIGINT) AS row, CAST(row_number() OVER w - 1 AS VARCHAR) AS number,
        name AS shared, name AS own FROM r WINDOW w AS (PARTITION BY file ORDER BY name)""", roles=False)
def workbook(spark, sf_dir):
    """Numbers, shared and inline texts of a sheet, by column; a workbook for each file."""
    rows = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"), "c_name")
    names = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("text"))  # FILE_ROWS at most
    books = R.workbook_rows(names.repartition("file").select(F.concat(F.col("file").cast("string"), F.lit(".xlsx")).alias("path"), _workbook(F.col("text")).alias("content")), "Data")
    return books.select("path", "row", F.col("cells")[1].alias("number"), F.col("cells")[2].alias("shared"), F.col("cells")[27].alias("own"))


@query("s18_envelope", "SELECT c_custkey AS code, CAST(c_nationkey * 1.5 AS DECIMAL(9,2)) AS amount, CAST(NULL AS INT) AS bad FROM customer", roles=False)
def envelope(spark, sf_dir):
    """Typed rows of nested envelopes, one for each file; what cannot be read is null."""
    fields = F.struct(F.col("c_custkey").cast("string").alias("code"), (F.col("c_nationkey") * 1.5).cast("string").alias("amount"), F.lit("x").alias("bad"))
    files = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"))
    text = files.agg(F.to_json(F.struct(F.struct(F.collect_list(fields).alias("results")).alias("d"))).alias("text"))  # FILE_ROWS at most
    return R.envelope_rows(text, "text", {"code": "bigint", "amount": "decimal(9,2)", "bad": "int"}).select("code", "amount", "bad")


@query("s19_keyed_objects", "SELECT c_name AS key, CAST(c_custkey AS BIGINT) AS code, c_nationkey % 2 = 0 AS even FROM customer", roles=False)
def keyed_objects(spark, sf_dir):
    """Objects of objects to rows, an object for each file."""
    entry = F.struct("c_name", F.struct(F.col("c_custkey").alias("code"), (F.col("c_nationkey") % 2 == 0).alias("even")))
    files = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / FILE_ROWS).alias("file"))
    text = files.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))  # FILE_ROWS at most
    rows = text.select(F.explode(R.keyed_objects("text", "code bigint, even boolean")).alias("key", "o"))
    return rows.select("key", "o.code", "o.even")


@query(
    "s20_page_links",
    "SELECT DISTINCT link, CASE WHEN regexp_matches(link, '20[0-9][0-9]') THEN CAST(regexp_extract(link, '20[0-9][0-9]') AS INT) END AS year FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) WHERE regexp_matches(link, '^/[a-z]')",
    roles=False,
)
def page_links(spark, sf_dir):
    """Addresses in pages, with the year in them."""
    return R.page_links(read(spark, sf_dir, "pages"), "html", "^/[a-z]")


@F.pandas_udf(T.BinaryType())
def _shape(sides: pd.Series) -> pd.Series:
    """A shape file with one polygon: a square of the given side, with a hole."""
    out = []
    for side in sides.astype(float):
        outer = [(0.0, 0.0), (0.0, side), (side, side), (side, 0.0), (0.0, 0.0)]
        points = outer + [(x / 4 + side / 4, y / 4 + side / 4) for x, y in outer]
        body = struct.pack("<i4d2i2i", 5, 0, 0, side, side, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in points)
        out.append(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def _table(names: pd.Series) -> pd.Series:
    """A dBase table with two rows: the name, and its length."""
    out = []
    for name in names:
        fields = b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15) for n, size in ((b"NAME", 20), (b"SIZE", 4)))
        rows = b"".join(b" " + x.encode("latin-1").ljust(20) + str(len(x)).encode().rjust(4) for x in (name, name.lower()))
        out.append(struct.pack("<BBBBIHH", 3, 0, 0, 0, 2, 32 + len(fields) + 1, 25) + bytes(20) + fields + b"\r" + rows)
    return pd.Series(out)


@query("s22_shapes", """SELECT n_nationkey + 1 AS side, CAST((n_nationkey + 1) * (n_nationkey + 1) AS DOUBLE) AS area,
        CAST((n_nationkey + 1) * (n_nationkey + 1) AS DOUBLE) / 16 AS hole, CAST(2 AS INT) AS rings FROM nation""", roles=False)
def shapes(spark, sf_dir):
    """Rings of polygons, and their areas."""
    from civicframe.functions.scalars import polygon_area

    side = (F.col("n_nationkey") + 1).alias("side")
    files = read(spark, sf_dir, "nation").select(side.cast("string").alias("path"), _shape(side).alias("content"))
    rings = R.shapes(files).select(F.col("path").cast("bigint").alias("side"), "parts")
    return rings.select("side", F.round(polygon_area(F.col("parts")[0]), 9).alias("area"), F.round(polygon_area(F.col("parts")[1]), 9).alias("hole"), F.size("parts").alias("rings"))


@query("s22_tables", """SELECT n_name AS path, CAST(k AS INT) AS number, CASE
        WHEN k = 1 THEN n_name ELSE lower(n_name) END AS name, CAST(length(n_name) AS INT) AS size FROM nation, (VALUES (1), (2)) AS v(k)""", roles=False)
def tables(spark, sf_dir):
    """Rows of dBase tables."""
    files = read(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), _table(F.col("n_name")).alias("content"))
    return R.dbf_rows(files).select("path", "number", F.col("fields")["NAME"].alias("name"), F.col("fields")["SIZE"].cast("int").alias("size"))
