"""MPEG audio columns: parse streams to exact durations and frame seek offsets, and carry payload bytes in silent frames.

``scan`` reads any MPEG-1/2/2.5 layer I-III stream with a bitrate in its headers (free format isn't read): it parses ID3v2 tags (2.2 to 2.4, with
unsynchronisation and extended headers), ID3v1 and the length of APE tags, and resynchronises on frame headers: a header counts if the next frame at
the computed distance agrees in version, layer and rate, if it agrees with the frame right before it and any frame, the end or a tag
follows, or if it stands right after a frame and its own checksum fits. It verifies the CRC-16 of protected frames of all layers over the bits that
the layer protects, reads a Xing, Info or VBRI table, and gives the exact duration, summed over the sample rates of the stream, and the offset of each frame.

``pack`` stores bytes losslessly: layer III mono frames at 32 kHz whose side information announces no main data are silence of
36 ms each; the bytes after the side information are ancillary data that decoders skip, and there the payload lies. The last
frame takes the smallest bitrate that holds the rest, so the stream has a variable bitrate and carries a table for it.

Null and empty texts: 64 zero bytes. Texts of any length are stored whole, one at a time. Equal texts give equal streams; repeated rows keep their
rows. Damaged streams: bytes that belong to no frame are counted in ``lost``, failed checksums in ``crc_errors``; a frame that fails its checksum
yields no payload. Empty tables give empty results. Columns beyond the id and the text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

# Fixed values of the format: kbit/s by bitrate index, for (MPEG-1, layer) and (MPEG-2/2.5, layer).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II: how many subbands have an allocation field of how many bits, by table.
ALLOCATION = {"wide": ((11, 4), (12, 3), (7, 2)), "narrow": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
TAG = b"ID3"
PAD = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int = 0) -> int:
    """Over whole bytes, or over the first ``bits`` bits."""
    c, whole = 0xFFFF, bits // 8 if bits else len(data)
    for b in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for i in range(bits % 8):
        bit = data[whole] >> 7 - i & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    bound: int = 32  # the first subband that the channels share
    form: tuple = ()  # what consecutive frames of a stream have in common

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None; free-format streams (bitrate index 0) aren't supported."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        index, rate = four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < index < 15 and rate != 3 and four[3] & 3 != 2:
            low, hz = version != 3, RATES[version][rate]
            bits, padding = BITRATES[2 if low else 1, layer][index] * 1000, four[2] >> 1 & 1
            samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
            size = (12 * bits // hz + padding) * 4 if layer == 1 else samples // 8 * bits // hz + padding
            mode, extension = four[3] >> 6, four[3] >> 4 & 3
            found = Header(version, layer, not four[1] & 1, bits, hz, mode == 3, size, samples, 4 * extension + 4 if mode == 1 else 32, (version, layer, hz))
    if len(_headers) < 65536:
        _headers[four] = found
    return found


@dataclass
class Scan:
    """What a stream holds. ``offsets`` are the frames' byte offsets, the table frame left out."""

    tag_bytes: int = 0
    tags: dict = field(default_factory=dict)
    old_tag: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    samples: int = 0
    rate: int = 0
    by_rate: dict = field(default_factory=dict)
    bitrates: dict = field(default_factory=dict)
    crc_checked: int = 0
    crc_errors: int = 0
    lost: int = 0
    resyncs: int = 0
    payload: list = field(default_factory=list)

    @property
    def duration(self) -> Fraction:
        return sum((Fraction(n, rate) for rate, n in self.by_rate.items()), Fraction(0))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _number(raw: bytes, bits: int = 8) -> int:
    out = 0
    for b in raw:
        out = out << bits | b & (1 << bits) - 1
    return out


def _text(body: bytes) -> str:
    return body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")


def _tags(data: bytes, at: int = 0) -> tuple[int, dict]:
    """Length and text frames of an ID3v2 tag at a place; length 0 if there is none."""
    head = data[at : at + 10]
    if head[:3] != TAG or len(head) < 10 or max(head[6:10]) > 127:
        return 0, {}
    major, flags, size = head[3], head[5], _number(head[6:10], 7)
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\x00", b"\xff")
    place = 0
    if flags & 0x40 and major >= 3:  # extended header; its size counts itself from 2.4 on
        place = _number(body[:4], 7) if major >= 4 else 4 + _number(body[:4])
    name_size, head_size = (3, 6) if major == 2 else (4, 10)
    out = {}
    while place + head_size <= len(body) and body[place]:
        raw = body[place + name_size : place + 2 * name_size]
        n = _number(raw, 7) if major >= 4 else _number(raw)
        part = body[place + head_size : place + head_size + n]
        if major >= 4 and (body[place + 9] & 0x02 or flags & 0x80):
            if body[place + 9] & 0x01:  # the length before unsynchronisation
                part = part[4:]
            part = part.replace(b"\xff\x00", b"\xff")
        if body[place : place + 1] == b"T" and part:
            name, text = body[place : place + name_size].decode("latin-1"), _text(part)
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            out[name] = text
        place += head_size + n
    return 10 + size + 10 * (major >= 4 and flags >> 4 & 1), out


def _old_tag(data: bytes) -> dict:
    """Fields of an ID3v1 tag in the last 128 bytes; with a track number (1.1) if a zero byte stands before it."""
    raw = data[-128:]
    if len(raw) < 128 or raw[:3] != b"TAG":
        return {}
    clean = lambda b: b.split(b"\0")[0].decode("latin-1").strip()
    out = {name: clean(raw[a:b]) for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))}
    if raw[125] == 0 and raw[126]:
        out["comment"], out["track"] = clean(raw[97:125]), raw[126]
    return out | {"genre": raw[127]}


def _trailing(data: bytes) -> tuple[int, dict]:
    """Length of the tags at the end, and the fields of an ID3v1 tag."""
    fields = _old_tag(data)
    size = 128 if fields else 0
    foot = data[len(data) - size - 32 : len(data) - size]
    if foot[:8] == b"APETAGEX":
        size += int.from_bytes(foot[12:16], "little") + 32 * (foot[23] >> 7)
    return min(size, len(data)), fields


def _table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI table of a first frame."""
    if frame[36:40] == b"VBRI":
        entries, scale, width, step = (int.from_bytes(frame[36 + i : 38 + i], "big") for i in (18, 20, 22, 24))
        toc = tuple(int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries if 62 + entries * width <= len(frame) else 0))
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "step": step, "toc": toc}
    at = next((a for a in (4 + 2 * h.protected + h.side, 4 + h.side) if frame[a : a + 4] in (b"Xing", b"Info")), None)
    if at is None:
        return {}
    flags, out = int.from_bytes(frame[at + 4 : at + 8], "big"), {"kind": frame[at : at + 4].decode()}
    at += 8
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(frame[at : at + 4], "big")
            at += 4
    if flags & 4:
        out["toc"] = tuple(frame[at : at + 100])
    return out


def guarded(data: bytes, at: int, h: Header) -> tuple[bytes, int]:
    """The bytes that begin with the bits under the frame's checksum, and how many bits these are."""
    head, rest, channels = data[at + 2 : at + 4], data[at + 6 : at + h.size], 1 if h.mono else 2
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (h.bound * channels + 32 - h.bound) if channels == 2 else 128
    else:
        rate = h.bitrate // 1000 // channels
        if h.version != 3:
            kind, bands = "low", 30
        elif rate < 56:
            kind, bands = "narrow", 12 if h.rate == 32000 else 8
        else:
            kind, bands = "wide", 30 if rate >= 96 and h.rate != 48000 else 27
        widths = [w for n, w in ALLOCATION[kind] for _ in range(n)][:bands]
        field, bits, used = int.from_bytes(rest[:32], "big"), 0, 0
        for band, width in enumerate(widths):
            shared = channels == 2 and band >= h.bound
            for _ in range(1 if shared else channels):
                value = field >> 256 - bits - width & (1 << width) - 1 if len(rest) >= 32 else 0
                bits += width
                used += (2 if shared else 1) * (value != 0)
        bits += 2 * used  # the scale factor selections follow
    return head + rest[: -(-bits // 8)], 16 + bits


_checked: dict[tuple[bytes, int], int] = {}


def crc_fits(data: bytes, at: int, h: Header) -> bool:
    found = guarded(data, at, h)
    want = _checked.get(found)
    if want is None:
        if len(_checked) > 65536:
            _checked.clear()
        _checked[found] = want = crc16(*found) if len(found[0]) * 8 >= found[1] else -1
    return want == data[at + 4] << 8 | data[at + 5]


def scan(data: bytes, payload: bool = False) -> Scan:
    """Parse a stream; with ``payload`` also collect the ancillary bytes of silent frames."""
    out, at = Scan(), 0
    while (found := _tags(data, at))[0]:
        at, out.tags = at + found[0], out.tags | found[1]
    out.tag_bytes = at
    tail, old_tag = _trailing(data)
    n = len(data)
    last = max(at, n - tail)  # where tags begin, if a frame ends there
    offsets, first, before = [], True, None  # before: the frame that ends here
    synced = True
    while at + 4 <= n:
        h = header(data[at : at + 4])
        end = at + h.size if h else 0
        fits = False
        if h is not None and end <= n:
            after = header(data[end : end + 4]) if end + 4 <= n else None
            fits = after is not None and after.form == h.form or end in (n, last) or end + 4 > n and synced
            if not fits and before is not None:
                fits = after is not None and before.form == h.form or h.protected and crc_fits(data, at, h)
        if not fits:
            if tail and at == last:
                out.old_tag, n = old_tag, at
                break
            if synced:
                out.resyncs += 1
                synced = False
            before = None
            upto = last if at < last else n
            found = data.find(b"\xff", at + 1, upto)
            out.lost += (found if found >= 0 else upto) - at
            at = found if found >= 0 else upto
            continue
        synced, good, before = True, True, h
        if h.protected:
            good = crc_fits(data, at, h)
            out.crc_checked += 1
            out.crc_errors += not good
        if first:
            first = False
            if table := _table(data[at:end], h):
                out.table, at = table, end
                continue
        offsets.append(at)
        out.samples += h.samples
        out.rate = out.rate or h.rate
        out.by_rate[h.rate] = out.by_rate.get(h.rate, 0) + h.samples
        out.bitrates[h.bitrate] = out.bitrates.get(h.bitrate, 0) + 1
        if payload and good and h.layer == 3:
            out.payload.append(data[at + 4 + 2 * h.protected + h.side : end])
        at = end
    out.lost += max(0, n - at)
    out.offsets = np.array(offsets, np.int64)
    return out


def _frame_head(index: int) -> bytes:
    """Header, CRC and empty side information: MPEG-1 layer III, 32 kHz, mono, protected."""
    two = bytes([index << 4 | 2 << 2, 3 << 6])
    side = bytes(17)
    return b"\xff\xfa" + two + crc16(two + side).to_bytes(2, "big") + side


_HEADS = [_frame_head(i) if i else b"" for i in range(15)]
_SIZES = [144 * kbit * 1000 // 32000 for kbit in BITRATES[1, 3]]
_ROOM = [s - 23 for s in _SIZES]


def pack(payload: bytes) -> bytes:
    """The payload as a stream: tag, table frame, data frames."""
    full = len(payload) // _ROOM[14]
    rest = payload[full * _ROOM[14] :]
    frames = [_HEADS[14] + payload[i * _ROOM[14] : (i + 1) * _ROOM[14]] for i in range(full)]
    if rest:
        index = next(i for i in range(1, 15) if _ROOM[i] >= len(rest))
        frames.append(_HEADS[index] + rest + bytes(_ROOM[index] - len(rest)))
    body = b"".join(frames)
    total = _SIZES[14] + len(body)
    starts = np.cumsum([_SIZES[14]] + [len(f) for f in frames])
    at = np.arange(100) * len(frames) // 100
    toc = np.minimum(255, starts[at] * 256 // total).astype(np.uint8).tobytes()
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag_text = b"\x03payload\x00%d:%08x" % (len(payload), zlib.crc32(payload))
    tag_body = b"TXXX" + _syncsafe(len(tag_text)) + b"\0\0" + tag_text
    tag = TAG + b"\4\0\0" + _syncsafe(len(tag_body)) + tag_body
    return tag + _HEADS[14] + table + bytes(_ROOM[14] - len(table)) + body


def unpack(stream: bytes) -> tuple[bytes, Scan]:
    """The payload read back from the frames, checked against the tag, and what the scan found."""
    found = scan(stream, payload=True)
    length, _, crc = found.tags.get("payload", "0:0").partition(":")
    data = b"".join(found.payload)[: int(length)]
    if len(data) != int(length) or zlib.crc32(data) != int(crc, 16):
        raise ValueError("the stored payload is damaged")
    return data, found


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def features(found: Scan) -> str:
    rates = ",".join(f"{b // 1000}x{c}" for b, c in sorted(found.bitrates.items()))
    seek = hashlib.sha256(found.offsets.astype("<i8").tobytes()).hexdigest()[:16]
    d = found.duration
    return f"frames={len(found.offsets)};samples={found.samples};duration={d.numerator}/{d.denominator};kbps={rates};crc={found.crc_checked - found.crc_errors}/{found.crc_checked};table={found.table.get('frames', 0)};seek={seek}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media column and what parsing it gives: ``media`` binary, exact duration as numerator/denominator, frame seek offsets."""

    def make():
        def apply(texts):
            media = [pack(payload_of(t)) for t in texts]
            found = [scan(m) for m in media]
            return {
                "media": media,
                "samples": [s.samples for s in found],
                "sample_rate": [s.rate for s in found],
                "crc_errors": [s.crc_errors for s in found],
                "seek_offsets": [s.offsets for s in found],
                "feature": [features(s) for s in found],
            }

        return apply

    return map_texts(df, id_col, text_col, "media binary, samples bigint, sample_rate int, crc_errors bigint, seek_offsets array<bigint>, feature string", make)


def store_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back, and return only lengths, digests and features."""

    def make():
        def apply(texts):
            rows = []
            for t in texts:
                media = pack(payload_of(t))
                data, found = unpack(media)
                rows.append((len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), features(found)))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return apply

    return map_texts(df, id_col, text_col, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", make)
