"""Metadata entries of files by their bytes alone: PDF information fields and XMP packets, PNG text chunks, JPEG and TIFF tags.

No decoder of pages or pixels is needed. What a file hides (encrypted PDF strings, unknown compression) gives no entry; a broken file gives what
was read before the break. Values are collapsed to single spaces and cut.
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_MOST = 500
#: Bytes that one compressed part may give.
INFLATED_MOST = 16 * 2**20
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")
# TIFF tags of texts.
TIFF_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9286: "UserComment", 0xA430: "CameraOwnerName"}
EXIF_POINTER = 0x8769
_NAME = re.compile(rb"/(" + b"|".join(k.encode() for k in INFO_KEYS) + rb")\s*(?=[(<])")
_STREAM = re.compile(rb"/Type\s*/ObjStm\b[^>]*>>\s*stream\r?\n|/ObjStm\b.{0,200}?stream\r?\n", re.S)
_XMP = re.compile(rb"<x:xmpmeta\b.*?</x:xmpmeta>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def inflated(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, INFLATED_MOST)
    except zlib.error:
        return b""


def pdf_string(raw: bytes, at: int) -> str | None:
    """A literal or hexadecimal PDF string at a place, as text."""
    if raw[at : at + 1] == b"<":
        end = raw.find(b">", at)
        digits = re.sub(rb"\s+", b"", raw[at + 1 : end if end >= 0 else at + 1])
        if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
            return None
        value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        out, depth, i = bytearray(), 0, at
        while i < len(raw):
            c = raw[i : i + 1]
            if c == b"\\":
                octal = re.match(rb"[0-7]{1,3}", raw[i + 1 : i + 4])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i += 1 + len(octal[0])
                    continue
                following = raw[i + 1 : i + 2]
                out += b"" if following in (b"\n", b"\r") else _ESCAPES.get(following, following)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            if i > at:
                out += c
            i += 1
        value = bytes(out)
    for mark, code in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if value.startswith(mark):
            return value[len(mark) :].decode(code, "replace")
    return value.decode("latin-1")


def xmp_entries(packet: bytes):
    """(name, value) of an XMP packet's simple properties and list items."""
    try:
        root = ET.fromstring(packet)
    except ET.ParseError:
        return
    for element in root.iter():
        name = element.tag.rsplit("}", 1)[-1]
        for key, value in element.attrib.items():
            if "}" in key and not key.rsplit("}", 1)[-1] in ("about", "lang", "xmptk", "parseType"):
                yield key.rsplit("}", 1)[-1], value
        if not len(element) and element.text and element.text.strip() and name != "li":
            yield name, element.text
        for item in element.iter("{http://www.w3.org/1999/02/22-rdf-syntax-ns#}li") if name not in ("RDF", "xmpmeta", "Description", "Alt", "Seq", "Bag", "li") else ():
            if item.text and item.text.strip():
                yield name, item.text


def pdf_entries(raw: bytes):
    """(origin, key, value): the last value of each information field, also in compressed object streams, and XMP properties."""
    parts = [raw]
    for m in _STREAM.finditer(raw):
        parts.append(inflated(raw[m.end() :]))
    encrypted = re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", raw) is not None
    info: dict[str, str] = {}
    for part in parts if not encrypted else ():
        for m in _NAME.finditer(part):
            if part[m.end() : m.end() + 2] != b"<<" and (value := pdf_string(part, m.end())):
                info[m[1].decode()] = value
    yield from (("info", k, v) for k, v in info.items())
    for packet in _XMP.findall(raw):
        yield from (("xmp", k, v) for k, v in xmp_entries(packet))
    if encrypted:
        yield "file", "Encrypted", "true"


def png_entries(raw: bytes):
    """Text chunks, plain, compressed and international, and the EXIF chunk."""
    at = 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body, at = raw[at + 8 : at + 8 + size], at + 12 + size
        key, _, rest = body.partition(b"\0")
        if kind == b"tEXt":
            yield "info", key.decode("latin-1"), rest.decode("latin-1")
        elif kind == b"zTXt":
            yield "info", key.decode("latin-1"), inflated(rest[1:]).decode("latin-1")
        elif kind == b"iTXt" and len(rest) > 2:
            packed, rest = rest[0], rest[2:]
            _, _, rest = rest.partition(b"\0")
            _, _, text = rest.partition(b"\0")
            text = inflated(text) if packed else text
            if key == b"XML:com.adobe.xmp":
                yield from (("xmp", k, v) for k, v in xmp_entries(text))
            else:
                yield "info", key.decode("latin-1"), text.decode("utf-8", "replace")
        elif kind == b"eXIf":
            yield from tiff_entries(body)
        elif kind == b"IEND":
            return


def tiff_entries(raw: bytes):
    """Text tags of the first directory and of the EXIF directory."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        return
    todo, seen = [struct.unpack(order + "I", raw[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(raw):
            continue
        seen.add(at)
        (n,) = struct.unpack(order + "H", raw[at : at + 2])
        for i in range(n):
            entry = raw[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, count, value = struct.unpack(order + "HHII", entry)
            if tag == EXIF_POINTER:
                todo.append(value)
            elif tag in TIFF_TAGS and kind in (2, 7):
                text = entry[8 : 8 + count] if count <= 4 else raw[value : value + count]
                yield "exif", TIFF_TAGS[tag], re.sub(rb"^(ASCII|UNICODE)?\0+", b"", text).rstrip(b"\0").decode("utf-8", "replace")


def jpeg_entries(raw: bytes):
    """EXIF and XMP of the application segments, and comments."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xDA, 0xD9):
        (size,) = struct.unpack(">H", raw[at + 2 : at + 4])
        kind, body, at = raw[at + 1], raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xE1 and body.startswith(b"Exif\0\0"):
            yield from tiff_entries(body[6:])
        elif kind == 0xE1 and (m := _XMP.search(body)):
            yield from (("xmp", k, v) for k, v in xmp_entries(m[0]))
        elif kind == 0xFE:
            yield "info", "comment", body.decode("utf-8", "replace")


def entries_of(raw: bytes) -> list[tuple[str, str, str]]:
    """(origin, key, value) sorted by key and origin, each once; values collapsed and cut, empty ones left out."""
    reader = pdf_entries if b"%PDF-" in raw[:1024] else png_entries if raw[:8] == b"\x89PNG\r\n\x1a\n" else jpeg_entries if raw[:2] == b"\xff\xd8" else tiff_entries
    out = []
    try:
        for origin, key, value in reader(raw):
            if text := " ".join(value.split())[:VALUE_MOST]:
                out.append((origin, key, text))
    except (struct.error, ValueError):
        pass  # what was read before the break stays
    return sorted(dict.fromkeys(out), key=lambda e: (e[1], e[0]))


def metadata_entries(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, origin, key, value) of files as bytes."""
    source = files.select(id_col, content_col)
    schema = T.StructType([source.schema[id_col], *T.StructType.fromDDL("origin string, key string, value string")])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                found = entries_of(batch.column(1)[i].as_py() or b"")
                at += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    return source.mapInArrow(run, schema)


def metadata_states(files: DataFrame, entries: DataFrame, markers: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, state): detected where a marker was found, not detected where there are entries without one, indeterminate without entries."""
    some = entries.select(id_col).distinct().withColumn("some", F.lit(True))
    hit = markers.select(id_col).distinct().withColumn("hit", F.lit(True))
    rows = files.select(id_col).join(some, id_col, "left").join(hit, id_col, "left")
    return rows.select(id_col, F.when(F.col("hit"), "detected").when(F.col("some"), "not_detected").otherwise("indeterminate").alias("state"))
