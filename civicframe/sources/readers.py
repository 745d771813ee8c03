"""Sources: delimited text, archives, workbooks, JSON envelopes, pages, shapes. All values stay text until they are cast.

Whole files go to executors as binary rows, one file a row; archives and workbooks are opened there.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from civicframe.operators.joins import CheckFailed

#: What windows-1252 has in place of the C1 controls; fixed values.
C1 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def delimited(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ";", header: bool = True, strict: bool = True) -> DataFrame:
    """Quoted text with doubled quotes and line breaks in quotes; short rows are padded with '', empty rows go.

    strict: the header must be columns in order, and quotes must close.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if strict:
        open_quote = spark.read.text(path, wholetext=True).filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
        if open_quote.limit(1).count():
            raise CheckFailed("a quote does not close")
    rows = spark.read.csv(path, schema=schema, sep=sep, quote='"', escape='"', header=header, multiLine=True, enforceSchema=not (strict and header), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    return rows.filter(F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in columns]).isNotNull()).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


#: Bytes that windows-1252 does not define.
UNDEFINED = r"[\x81\x8D\x8F\x90\x9D]"


def decoded(content: Column) -> Column:
    """Struct of text and the encoding used: UTF-8 without its mark, else windows-1252, else (a byte that this lacks) ISO 8859-1."""
    utf8, latin = F.is_valid_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    other = latin.rlike(UNDEFINED)
    text = F.when(utf8, F.regexp_replace(content.cast("string"), "^\ufeff", "")).when(other, latin).otherwise(F.translate(latin, C1, CP1252))
    return F.struct(text.alias("text"), F.when(utf8, "utf-8").when(other, "iso-8859-1").otherwise("windows-1252").alias("encoding"))


def line_policy(content: Column) -> Column:
    """Struct of what a file has that a strict one has not: a byte order mark, carriage returns, an open last line."""
    latin = F.decode(content, "ISO-8859-1")
    return F.struct(
        latin.startswith("\u00ef\u00bb\u00bf").alias("mark"), F.contains(latin, F.lit("\r")).alias("carriage_returns"), ((latin != "") & ~latin.endswith("\n")).alias("open_end")
    )


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """The same rows; a table without any is an error (a job of its own looks for one)."""
    if df.isEmpty():
        raise CheckFailed(f"{what} has no rows")
    return df


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sniffed_separator(header: str) -> str:
    """The most frequent of ; tab , | in a header, tab when none occurs."""
    best = max(";\t,|", key=header.count)
    return best if best in header else "\t"


def zip_members(archives: DataFrame, pattern: str = "", exactly: int | None = None, lock: dict | None = None) -> DataFrame:
    """path, member, content of the members whose name matches; also inside archives within archives.

    exactly: how many must match. lock: name, size, crc32, sha256 that the one member must have, unencrypted.
    """

    def opened(path: str, raw: bytes, depth: int = 0) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if info.is_dir() or info.filename.startswith("__MACOSX/"):
                    continue
                if info.flag_bits & 1:
                    raise CheckFailed(f"{info.filename} is encrypted")
                if info.filename.lower().endswith(".zip") and depth < 1:
                    yield from opened(path, z.read(info), depth + 1)
                elif re.search(pattern, info.filename):
                    yield path, info.filename, z.read(info)

    def run(batches):
        import hashlib

        for frame in batches:
            for path, raw in zip(frame.path, frame.content):
                n = 0
                for row in opened(path, bytes(raw)):  # a member at a time
                    n += 1
                    found = {"name": row[1], "size": len(row[2]), "crc32": zlib.crc32(row[2]), "sha256": hashlib.sha256(row[2]).hexdigest()} if lock else {}
                    if bad := [k for k in lock or () if found[k] != lock[k]]:
                        raise CheckFailed(f"{path}: {', '.join(bad)} differ")
                    yield pd.DataFrame([row], columns=["path", "member", "content"])
                if exactly is not None and n != exactly:
                    raise CheckFailed(f"{path}: {n} members match")

    return archives.mapInPandas(run, "path string, member string, content binary")


def member_states(archives: DataFrame, pattern: str) -> DataFrame:
    """path and state of archives (path, content, lock: name, size, crc32, sha256): as locked, or what of the one member that matches differs."""

    def run(batches):
        import hashlib

        for frame in batches:
            out = []
            for path, raw, lock in zip(frame.path, frame.content, frame.lock):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    members = [i for i in z.infolist() if not i.is_dir() and re.search(pattern, i.filename)]
                    if len(members) != 1 or members[0].flag_bits & 1:
                        out.append((path, "encrypted" if len(members) == 1 else f"{len(members)} members"))
                        continue
                    data = z.read(members[0])
                found = {"name": members[0].filename, "size": len(data), "crc32": zlib.crc32(data), "sha256": hashlib.sha256(data).hexdigest()}
                out.append((path, ", ".join(k for k, v in found.items() if lock[k] != v) or "as locked"))
            yield pd.DataFrame(out, columns=["path", "state"])

    return archives.mapInPandas(run, "path string, state string")


def csv_rows(texts: DataFrame, text_col: str, columns: list[str], sep: str = ",", header: bool = False) -> DataFrame:
    """Rows of files that are columns of text, with doubled quotes and line breaks in quotes; rows of another width are `malformed`: what they lack is null, what they have too much goes.

    header: the first row of each file must be the columns in order, else its job fails. Blank rows go.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", malformed boolean"

    def run(batches):
        for frame in batches:
            for text in frame.iloc[:, 0]:
                rows = csv.reader(io.StringIO(text or "", newline=""), delimiter=sep)
                if header and (names := next(rows, [])) != list(columns):
                    raise CheckFailed(f"columns: {names} in place of {list(columns)}")
                out = []
                for row in rows:
                    if not any(map(str.strip, row)):
                        continue
                    out.append((*(row + [None] * len(columns))[: len(columns)], len(row) != len(columns)))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=[*columns, "malformed"])
                        out = []
                yield pd.DataFrame(out, columns=[*columns, "malformed"])

    return texts.select(text_col).mapInPandas(run, schema)


def workbook_rows(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, sheet, row, cells (column number -> text) of workbooks' rows; sheet: the only one to read."""

    def run(batches):
        import xml.etree.ElementTree as ET

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for frame in batches:
            for path, raw in zip(frame.path, frame.content):
                out = []  # one workbook at a time
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
                    if sheet is not None and sheet not in (x.get("name") for x in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")):
                        raise CheckFailed(f"{path}: no sheet {sheet}")
                    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet"):
                        if sheet is not None and s.get("name") != sheet:
                            continue
                        target = rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
                        for r in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{ns}row"):
                            cells = {}
                            for c in r.iter(f"{ns}c"):
                                v = c.find(f"{ns}v")
                                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                                if text is not None:
                                    cells[column_number(c.get("r"))] = shared[int(text)] if c.get("t") == "s" else text
                            out.append((path, s.get("name"), int(r.get("r")), cells))
                yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return books.mapInPandas(run, "path string, sheet string, row long, cells map<int,string>")


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n


def odata(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of the OData envelopes (d.results) of files."""
    return envelope_rows(spark.read.text(path, wholetext=True), "value", fields)


def envelope_rows(texts: DataFrame, text_col: str, fields: dict[str, str]) -> DataFrame:
    """Rows of OData envelopes (d.results) in a column of text; every field is read as text and cast to its type, unreadable is null."""
    inner = ", ".join(f"`{f}`: string" for f in fields)
    rows = texts.select(F.explode(F.from_json(text_col, f"d struct<results: array<struct<{inner}>>>")["d"]["results"]).alias("r"))
    return rows.select(*[F.col(f"r.`{f}`").try_cast(kind).alias(f) for f, kind in fields.items()])


def keyed_objects(column: str | Column, fields: str) -> Column:
    """An object of objects, as text, to a map of structs; explode it for rows."""
    return F.from_json(column, f"map<string, struct<{fields}>>")


def page_links(pages: DataFrame, html_col: str, pattern: str) -> DataFrame:
    """Distinct links of pages whose address matches, with the latest year in the address."""
    links = pages.select(F.explode(F.regexp_extract_all(html_col, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1)).alias("link")).filter(F.col("link").rlike(pattern)).distinct()
    return links.withColumn("year", F.nullif(F.regexp_extract("link", r"(20\d{2})", 1), F.lit("")).cast("int"))


def registry_documents(rows: DataFrame, series: str, kind: str) -> DataFrame:
    """Documents of one series and type of a registry: kind and year by their titles; exact repetitions once, variants apart.

    An unknown title, or a blank in a field that is needed, is an error.
    """
    own = rows.filter((F.trim("series") == series) & (F.trim("type") == kind)).withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    of = {"account": "rendiconto delle entrate e delle spese del senato", "budget": "progetto di bilancio interno del senato"}
    year = F.regexp_extract(F.lower("title"), rf"^(?:{'|'.join(of.values())}) per l'anno finanziario (\d{{4}})$", 1)
    known = F.when(F.lower("title").startswith(of["account"]), "account").otherwise("budget")
    blank = F.exists(F.array(*[F.trim(c) for c in ("document", "number", "title", "presented")]), lambda c: F.coalesce(c, F.lit("")) == "")
    refused = F.when(blank, F.raise_error(F.lit("registry: a field is blank"))).when(year == "", F.raise_error(F.concat(F.lit("registry: unknown title "), "title")))
    found = own.select(known.alias("kind"), F.coalesce(refused, year).cast("int").alias("year"), F.col("number").cast("int").alias("number"), "document", F.to_date("presented").alias("presented"))
    return found.distinct()


def shapes(content: DataFrame) -> DataFrame:
    """path, number, parts (rings of x, y) of the polygons of shape files."""

    def run(batches):
        for frame in batches:
            for path, raw in zip(frame.path, frame.content):
                out = []  # one file at a time
                data, at = bytes(raw), 100
                while at + 12 <= len(data):
                    number, words = struct.unpack_from(">ii", data, at)
                    kind = struct.unpack_from("<i", data, at + 8)[0]
                    if kind in (5, 15, 25):
                        n_parts, n_points = struct.unpack_from("<ii", data, at + 44)
                        starts = [*struct.unpack_from(f"<{n_parts}i", data, at + 52), n_points]
                        points = struct.unpack_from(f"<{2 * n_points}d", data, at + 52 + 4 * n_parts)
                        rings = [[{"x": points[2 * i], "y": points[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]
                        out.append((path, number, rings))
                    at += 8 + 2 * words
                yield pd.DataFrame(out, columns=["path", "number", "parts"])

    return content.mapInPandas(run, "path string, number int, parts array<array<struct<x: double, y: double>>>")


def dbf_rows(content: DataFrame) -> DataFrame:
    """path, number, fields (name -> text) of dBase tables."""

    def run(batches):
        for frame in batches:
            for path, raw in zip(frame.path, frame.content):
                out = []  # one file at a time
                data = bytes(raw)
                n, head, size = struct.unpack_from("<IHH", data, 4)
                fields, at = [], 32
                while data[at] != 0x0D:
                    fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
                    at += 32
                for i in range(n):
                    pos, row = head + i * size + 1, {}
                    for name, width in fields:
                        row[name] = data[pos : pos + width].decode("latin-1").strip()
                        pos += width
                    out.append((path, i + 1, row))
                yield pd.DataFrame(out, columns=["path", "number", "fields"])

    return content.mapInPandas(run, "path string, number int, fields map<string,string>")


def simplified(ring: Column, tolerance: float) -> Column:
    """A line with fewer points, none of which moved by more than tolerance (Douglas and Peucker)."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([_thinned([(p["x"], p["y"]) for p in r], tolerance) for r in rings])

    return run(ring)


def _thinned(points: list[tuple], tolerance: float) -> list[dict]:
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        far = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5 for x, y in points[a + 1 : b]]
        most = max(range(len(far)), key=far.__getitem__)
        if far[most] > tolerance:
            keep.add(a + 1 + most)
            stack += [(a, a + 1 + most), (a + 1 + most, b)]
    return [{"x": points[i][0], "y": points[i][1]} for i in sorted(keep)]
