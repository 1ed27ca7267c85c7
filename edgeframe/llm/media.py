"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass. A magic alone proves
nothing, so a validator of its format walks the structure that follows (chunk lengths, checksums,
block chains, header arithmetic) and gives the end of the medium or rejects it. Accepted media are
carved as (type, offset, length), scanning goes on behind them, and the declared type is corrected to
the type of a medium that starts the content.

Defined cases: null content is empty and has no media; a text's payload is never empty, since padding
makes it at least one row; equal contents give equal results; an empty table gives no rows; repeated
rows stand side by side; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = 576

# ---------------------------------------------------------------- validators: (bytes, start) -> end or None


def _png(b: bytes, at: int) -> int | None:
    at += 8
    first = True
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + n
        if end > len(b) or (first and kind != b"IHDR") or zlib.crc32(memoryview(b)[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        at, first = end, False
    return None


def _riff(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    seen, at = set(), at + 12
    while at + 8 <= end <= len(b):
        kind, n = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        seen.add(kind)
        at += 8 + n + n % 2
    return end if at == end and {b"fmt ", b"data"} <= seen else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, pixels, head, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or head != 40 or planes != 1 or packed or depth not in (1, 4, 8, 24, 32) or width <= 0:
        return None
    row = (width * depth + 31) // 32 * 4
    return at + size if pixels + row * abs(height) == size and at + size <= len(b) else None


_PGM_HEAD = re.compile(rb"P5\s(?:#[^\n]*\n)?(\d{1,9})\s(\d{1,9})\s(\d{1,5})\s")


def _pgm(b: bytes, at: int) -> int | None:
    m = _PGM_HEAD.match(b, at)
    if not m:
        return None
    width, height, top = map(int, m.groups())
    end = m.end() + width * height * (1 + (top > 255))
    return end if 0 < top < 65536 and width * height and end <= len(b) else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 128 else 0
    at += 13 + table(b[at + 10])

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + table(b[at + 9]))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    at += 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return None
        at += 2 + n
        if kind == 0xDA:  # entropy-coded data, up to the next marker that is neither stuffed nor a restart
            m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(b, at)
            if not m:
                return None
            at = m.start()
    return at + 2 if b[at : at + 2] == b"\xff\xd9" else None


#: Magic bytes of each format and its validator (fixed values of the formats).
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int], int | None]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"RIFF": ("audio/wav", _riff),
    b"BM": ("image/bmp", _bmp),
    b"P5": ("image/x-portable-graymap", _pgm),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def carve(content: bytes, magics: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media in ``content``, in order, none inside another."""
    text, out, at = content.decode("latin-1"), [], 0
    while at < len(content):
        for last, magic in magics.iter(text, at):
            start = last - len(magic) + 1
            kind, valid = FORMATS[magic]
            try:
                end = valid(content, start) if start >= at else None
            except struct.error:
                end = None
            if end is not None:
                out.append((kind, start, end - start))
                at = end
                break
        else:
            break
    return out


def sniff(content: Column, declared: Column) -> Column:
    """Struct: type (corrected), corrected (the declared type was wrong), carved array<struct<type, offset, length>>."""

    @F.pandas_udf("type string, corrected boolean, carved array<struct<type:string,offset:long,length:long>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        magics = automaton()
        for blobs, types in batches:
            rows = []
            for blob, kind in zip(blobs, types):
                found = carve(blob or b"", magics)
                true = found[0][0] if found and found[0][1] == 0 else kind
                rows.append((true, true != kind, [{"type": k, "offset": o, "length": n} for k, o, n in found]))
            yield pd.DataFrame(rows, columns=["type", "corrected", "carved"])

    return run(content, declared)


# ---------------------------------------------------------------- storing texts as media


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // ROW))
    return raw + b"\xff" * (rows * ROW - len(raw)), len(raw)


def encode(payload: bytes, kind: str) -> bytes:
    """``payload`` as the 8-bit samples of a medium, ROW samples a line in images."""
    height = len(payload) // ROW
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == "image/x-portable-graymap":
        return b"P5\n%d %d\n255\n" % (ROW, height) + payload
    if kind == "image/bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 1024 + len(payload), 0, 54 + 1024, 40, ROW, -height, 1, 8, 0, len(payload), 2835, 2835, 256, 256)
        return head + grey + payload
    if kind == "image/png":
        lines = np.zeros((height, ROW + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def decode(medium: bytes, kind: str) -> bytes:
    """The samples of a medium that ``encode`` could have made."""
    if kind == "audio/wav":
        at = 12
        while medium[at : at + 4] != b"data":
            n = struct.unpack_from("<I", medium, at + 4)[0]
            at += 8 + n + n % 2
        return medium[at + 8 : at + 8 + struct.unpack_from("<I", medium, at + 4)[0]]
    if kind == "image/x-portable-graymap":
        return medium[_PGM_HEAD.match(medium).end() :]
    if kind == "image/bmp":
        return medium[struct.unpack_from("<I", medium, 10)[0] :]
    if kind == "image/png":
        at, data = 8, b""
        while at < len(medium):
            n, chunk = struct.unpack_from(">I4s", medium, at)
            data += medium[at + 8 : at + 8 + n] if chunk == b"IDAT" else b""
            at += 12 + n
        return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()
    raise ValueError(kind)


STORED = ["audio/wav", "image/png", "image/bmp", "image/x-portable-graymap"]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content (a medium), declared (a type that is wrong for half of the contents)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                payload, n = payload_of(text)
                mark = zlib.crc32(payload)
                rows.append((doc_id, n, encode(payload, STORED[mark % 4]), STORED[mark % 4 if mark & 4 else (mark + 1) % 4]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "content", "declared"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, content binary, declared string")


def describe(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and share of rising steps of 8-bit samples."""
    s = np.frombuffer(samples, np.uint8)
    p = np.bincount(s, minlength=256) / len(s)
    levels = np.arange(256)
    mean = float(p @ levels)
    some = p[p > 0]
    rising = float((s[1:] > s[:-1]).mean()) if len(s) > 1 else 0.0
    return f"mean={mean:.4f};sd={float(np.sqrt(p @ (levels - mean) ** 2)):.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};rising={rising:.4f}"


def read_back(stored: DataFrame) -> DataFrame:
    """The digest of stored media, each decoded from what was carved from its content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, n, content, found in zip(pdf["doc_id"], pdf["n_bytes"], pdf["content"], pdf["found"]):
                first = found["carved"][0]
                medium = content[first["offset"] : first["offset"] + first["length"]]
                payload = decode(medium, first["type"])
                rows.append((
                    doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(medium), hashlib.sha256(medium).hexdigest(),
                    f"{found['type']};{describe(payload)}", found["type"], bool(found["corrected"]),
                ))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"
    return stored.mapInPandas(run, shape)


def digest(docs: DataFrame) -> DataFrame:
    # Ids pass through Python as strings, which keep null and every digit.
    kept = store(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    out = read_back(kept.withColumn("found", sniff(F.col("content"), F.col("declared"))))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
