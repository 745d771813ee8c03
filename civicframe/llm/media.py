"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a binary
column; a validator for each format then confirms structure and lengths at every hit. The hit at
byte 0 corrects the declared type, confirmed hits further in are embedded media, given as spans
that can be carved. Storing a payload as 8-bit PCM in a WAV container and cutting it out again are
plain binary expressions in the JVM.

Null and empty bytes have type null and no spans. Magic bytes whose structure does not hold are
ignored, so text that happens to hold "BM" or "RIFF" stays what it is. Payloads of any length up to
the container's 4 GB are read whole, each byte a few times at most. Equal bytes give equal results,
repeated rows repeated ones, an empty table an empty table. Of embedded media that overlap the first
counts. Other columns stay; if the new column's name is taken it gets a _ behind it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from civicframe.llm.common import free_name, table

#: The formats' magic bytes.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"BM": "image/bmp",
    b"RIFF": "audio/wav", b"%PDF-": "application/pdf", b"PK\x03\x04": "application/zip", b"\x1f\x8b\x08": "application/gzip", b"fLaC": "audio/flac", b"OggS": "audio/ogg",
}
RATE = 8000
PAD = 64
SNIFFED = "type string, declared_ok boolean, length long, data_start long, data_length long, embedded array<struct<type: string, start: long, length: long>>, feature string"
_automaton = None


def _png(b: bytes, at: int):
    pos = at + 8
    if b[pos + 4 : pos + 8] != b"IHDR":
        return None
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        pos += 12 + size
        if kind == b"IEND":
            return pos - at, at + 8, pos - at - 8
    return None


def _jpeg(b: bytes, at: int, find):
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:
            end = find(b"\xff\xd9", pos + 2 + size)
            return None if end < 0 else (end + 2 - at, pos + 2 + size, end - pos - 2 - size)
        if not 0xC0 <= mark <= 0xFE or size < 2:
            return None
        pos += 2 + size
    return None


def _gif(b: bytes, at: int):
    if at + 14 > len(b):
        return None
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at, at + 13, pos - at - 13
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _bmp(b: bytes, at: int):
    if at + 30 > len(b):
        return None
    size, _, off, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head not in (12, 40, 52, 56, 64, 108, 124) or not 14 + head <= off <= size <= len(b) - at:
        return None
    pixels = ((width * bits + 31) // 32) * 4 * abs(height)
    return (size, at + off, pixels) if width > 0 and off + pixels <= size else None


def _wav(b: bytes, at: int):
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if size < 44 or at + size > len(b):
        return None
    pos, end, form = at + 12, at + size, None
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + n > end:
            return None
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", b, pos + 8)
        if kind == b"data":
            ok = form and form[4] == form[1] * form[5] // 8 and form[3] == form[2] * form[4] and form[4] and n % form[4] == 0
            return (size, pos + 8, n) if ok else None
        pos += 8 + n + n % 2
    return None


def _pdf(b: bytes, at: int, find):
    end = find(b"%%EOF", at)
    return (end + 5 - at, at, end + 5 - at) if end > 0 and 0 < find(b"obj", at) < end else None


def _zip(b: bytes, at: int, find):
    end = find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, off, note = struct.unpack_from("<IIH", b, end + 12)
    return (end + 22 + note - at, at, end - at) if at + off + size == end and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int):
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    try:
        z = zlib.decompressobj(31)
        left = memoryview(b)[at:]
        step = 1 << 16
        for pos in range(0, len(left), step):  # in pieces: what is unpacked is not kept
            z.decompress(left[pos : pos + step])
            if z.eof:
                return pos + step - len(z.unused_data) - max(0, pos + step - len(left)), at, len(left)
    except zlib.error:
        return None
    return None


def _flac(b: bytes, at: int):
    return (len(b) - at, at + 42, len(b) - at - 42) if b[at + 4 : at + 8] in (b"\0\0\0\x22", b"\x80\0\0\x22") and len(b) >= at + 42 else None


def _ogg(b: bytes, at: int):
    pos = at
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        n = b[pos + 26]
        step = 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos + step > len(b):
            return None
        last = b[pos + 5] & 4
        pos += step
        if last:
            return pos - at, at, pos - at
    return None


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg}


#: Formats whose end has to be searched for.
SEARCHED = ("application/pdf", "application/zip", "image/jpeg")


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            _automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        _automaton.make_automaton()
    return _automaton


class Finder:
    """Places of byte strings in order: what has been looked through is not looked through again."""

    def __init__(self, data: bytes):
        self.data, self.last = data, {}

    def __call__(self, what: bytes, at: int) -> int:
        """The first place from at on, or -1."""
        begin, place = self.last.get(what, (at, None))
        if at < begin:
            before = self.data.find(what, at, begin + len(what) - 1)
            return place if before < 0 else before
        if place is None or -1 < place < at:
            place = self.data.find(what, at)
        self.last[what] = (at, place)
        return place


def sniff(data: bytes) -> tuple[tuple | None, list[tuple[str, int, int]]]:
    """((type, length, data start, data length) at byte 0 or None, embedded (type, start, length))."""
    top, inside, free, find = None, [], 0, Finder(data)
    for end, (size, kind) in automaton().iter(data.decode("latin-1")):
        at = end - size + 1
        if at and at < free:
            continue  # within embedded media that is confirmed already
        got = VALIDATORS[kind](data, at, find) if kind in SEARCHED else VALIDATORS[kind](data, at)
        if got and at == 0:
            top = (kind, *got)
        elif got:
            inside.append((kind, at, got[0]))
            free = at + got[0]
    return top, inside


def _feature(data: bytes, top: tuple | None) -> str:
    if not top:
        return "unknown"
    sample = np.frombuffer(data, np.uint8, top[3], top[2]).astype(np.int64) - 128 if top[3] else np.zeros(1, np.int64)
    turns = int(np.count_nonzero((sample[1:] < 0) != (sample[:-1] < 0)))
    return f"{top[0]};bytes={top[3]};peak={int(np.abs(sample).max())};energy={int((sample * sample).sum())};crossings={turns}"


def sniffed(df: DataFrame, media_col: str, declared_col: str, out: str = "sniffed") -> DataFrame:
    """Adds the struct column out (SNIFFED): the confirmed type, whether the declared one was right, spans and features."""
    (out,) = free_name(df, out)

    @F.pandas_udf(SNIFFED)
    def look(media: pd.Series, declared: pd.Series) -> pd.DataFrame:
        rows = []
        for data, said in zip(media, declared):
            data = bytes(data or b"")
            top, inside = sniff(data)
            kind, length, start, size = top or (None, None, None, None)
            rows.append((kind, kind == said, length, start, size, [{"type": k, "start": a, "length": n} for k, a, n in inside], _feature(data, top)))
        frame = pd.DataFrame(rows, columns=["type", "declared_ok", "length", "data_start", "data_length", "embedded", "feature"])
        return frame.astype({c: "Int64" for c in ("length", "data_start", "data_length")})

    return df.withColumn(out, look(F.col(media_col), F.col(declared_col)))


def carved(media: Column, start: Column, length: Column) -> Column:
    """The bytes of a span."""
    return F.substring(media, start.cast("int") + 1, length.cast("int"))


def _le(n: Column, size: int) -> Column:
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0")) for i in range(size)])


def padded(text: Column) -> Column:
    """UTF-8 bytes of text (null: empty), filled with zeros to a positive multiple of PAD."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.greatest(F.ceil(F.octet_length(raw) / PAD) * PAD, F.lit(PAD).cast("long")).cast("int")
    return F.rpad(raw, n, F.lit(b"\0"))


def stored_wav(payload: Column) -> Column:
    """The payload as 8-bit mono PCM in a WAV container."""
    n, raw = F.octet_length(payload), lambda b: F.lit(b)
    form = struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return F.concat(raw(b"RIFF"), _le(n + 36, 4), raw(b"WAVEfmt " + form + b"data"), _le(n, 4), payload)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = docs.select(
        "doc_id",
        F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("n_bytes"),
        stored_wav(padded(F.col("text"))).alias("media"),
        F.lit("application/octet-stream").alias("declared"),
    )
    found = sniffed(raw, "media", "declared")
    payload = carved(F.col("media"), F.col("sniffed.data_start"), F.col("sniffed.data_length"))
    return found.select(
        "doc_id", "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -PAD, PAD)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "sniffed.feature",
        F.col("sniffed.type").alias("media_type"),
        F.size("sniffed.embedded").cast("long").alias("n_embedded"),
    )
