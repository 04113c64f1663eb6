"""Streams of other encoders: checksums of all layers, tables, tags, mixed rates; payloads that look like tags."""

import random
import struct
from fractions import Fraction

import pytest

from quillmark.llm import media


def plain_crc(bits):
    c = 0xFFFF
    for bit in bits:
        carry = (c >> 15) ^ bit
        c = (c << 1) & 0xFFFF
        if carry:
            c ^= 0x8005
    return c


def bits_of(data):
    return [b >> i & 1 for b in data for i in range(7, -1, -1)]


#: subbands by (bitrate a channel >= 56, rate 32 kHz, ...) written out as the format's tables have them
def layer2_widths(version, rate_kbit, hz):
    if version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    if rate_kbit < 56:
        return [4] * 2 + [3] * (10 if hz == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if rate_kbit >= 96 and hz != 48000 else 4)


def plain_protected(frame, layer, channels, bound, widths):
    """The protected bits, read one field after another."""
    bits = bits_of(frame[6:])
    place, used = 0, 0
    fields = [(4, 32)] if layer == 1 else None
    for band in range(32 if fields else len(widths)):
        width = 4 if fields else widths[band]
        for c in range(1 if channels == 2 and band >= bound else channels):
            value = int("".join(map(str, bits[place : place + width])), 2)
            place += width
            used += (value != 0) * (2 if channels == 2 and band >= bound else 1)
    if layer == 2:
        place += 2 * used
    return bits_of(frame[2:4]) + bits[:place]


@pytest.mark.parametrize(
    ("head", "layer", "channels", "bound"),
    [
        (b"\xff\xfe\x90\x00", 1, 2, 32), (b"\xff\xfe\x90\xc0", 1, 1, 32), (b"\xff\xfe\x90\x50", 1, 2, 8), (b"\xff\xfc\x90\x00", 2, 2, 32), (b"\xff\xfc\xc0\x00", 2, 2, 32),
        (b"\xff\xfc\x90\xc0", 2, 1, 32), (b"\xff\xfc\x20\x00", 2, 2, 32), (b"\xff\xfc\x98\x60", 2, 2, 12), (b"\xff\xfc\x28\xc0", 2, 1, 32), (b"\xff\xf4\x90\x00", 2, 2, 32), (b"\xff\xf4\x90\xc0", 2, 1, 32),
    ],
)
def test_checksums_of_layers_one_and_two(head, layer, channels, bound):
    r = random.Random(head[2])
    h = media.header(head)
    assert (h.layer, h.protected, h.mono) == (layer, True, channels == 1)
    widths = layer2_widths(h.version, h.bitrate // 1000 // channels, h.rate) if layer == 2 else None
    frames = []
    for _ in range(3):
        body = bytes(r.randrange(256) for _ in range(h.size - 6))
        frame = head + b"\0\0" + body
        crc = plain_crc(plain_protected(frame, layer, channels, bound, widths))
        frames.append(head + crc.to_bytes(2, "big") + body)
    found = media.scan(b"".join(frames))
    assert (found.crc_checked, found.crc_errors, len(found.offsets)) == (3, 0, 3)
    broken = bytearray(b"".join(frames))
    broken[h.size + 6] ^= 0x10
    assert media.scan(bytes(broken)).crc_errors == 1


def silent(head, n):
    return (head + bytes(media.header(head).size - 4)) * n


def test_duration_is_summed_by_rate():
    stream = silent(b"\xff\xfb\x90\x00", 7) + silent(b"\xff\xfb\x94\x00", 9)  # 44.1 kHz, then 48 kHz
    found = media.scan(stream)
    assert found.duration == Fraction(7 * 1152, 44100) + Fraction(9 * 1152, 48000) and found.lost == 0 and len(found.offsets) == 16


def test_headers_have_to_agree():
    h = media.header(b"\xff\xfb\x90\x00")
    stray = b"\xff\xfb\x90\x00" + bytes(h.size - 4) + b"\xff\xf3\x40\xc0" + bytes(30)  # followed by a header of another kind
    found = media.scan(b"junk" + stray + silent(b"\xff\xfb\x90\x00", 4))
    assert len(found.offsets) == 4 and found.offsets[0] == 4 + len(stray) and found.lost == 4 + len(stray)


def test_vbri_table():
    h = media.header(b"\xff\xfb\x90\x00")
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4567, 12, 3, 2, 2, 4) + struct.pack(">3H", 100, 200, 300)
    frame = b"\xff\xfb\x90\x00" + bytes(32) + table
    found = media.scan(frame + bytes(h.size - len(frame)) + silent(b"\xff\xfb\x90\x00", 5))
    assert found.table == {"kind": "VBRI", "bytes": 4567, "frames": 12, "step": 4, "toc": (200, 400, 600)} and len(found.offsets) == 5


def tag2(major, flags, body):
    return b"ID3" + bytes([major, 0, flags]) + media._syncsafe(len(body)) + body


def test_tags():
    sound = silent(b"\xff\xfb\x90\x00", 3)
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Someone".ljust(30) + b"Album".ljust(30, b"\0") + b"1999" + b"Said".ljust(28, b"\0") + b"\0\x07\x11"
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32 + 10, 1, 0) + bytes(8)
    found = media.scan(sound + bytes(10) + ape + old)
    assert found.old_tag == {"title": "Song", "artist": "Someone", "album": "Album", "year": "1999", "comment": "Said", "track": 7, "genre": 17}
    assert len(found.offsets) == 3 and found.lost == 0
    text = b"\x01" + "Naïve ÿ".encode("utf-16")
    assert media.scan(tag2(3, 0, b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text) + sound).tags == {"TIT2": "Naïve ÿ"}
    whole = (b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text).replace(b"\xff", b"\xff\x00")
    assert media.scan(tag2(3, 0x80, whole) + sound).tags == {"TIT2": "Naïve ÿ"}
    extended = b"\0\0\0\x06" + bytes(6) + b"TPE1" + (4).to_bytes(4, "big") + b"\0\0" + b"\0abc"
    assert media.scan(tag2(3, 0x40, extended) + sound).tags == {"TPE1": "abc"}
    newer = media._syncsafe(6) + b"\x01\0" + b"TPE1" + media._syncsafe(4) + b"\0\0" + b"\3abc"
    assert media.scan(tag2(4, 0x40, newer) + sound).tags == {"TPE1": "abc"}
    assert media.scan(tag2(2, 0, b"TT2\0\0\x04\0abc") + sound).tags == {"TT2": "abc"}
    assert media.scan(tag2(3, 0, b"TIT2" + (4).to_bytes(4, "big") + b"\0\0\0abc" + bytes(20)) + tag2(4, 0, b"TPE1" + media._syncsafe(4) + b"\0\0\3xyz") + sound).tags == {"TIT2": "abc", "TPE1": "xyz"}


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX" + struct.pack("<IIII", 2000, 500, 1, 0), b"ID3\4\0\0\0\0\0\x10", b"\xff\xfa\x98\xc0", b"\xff\xfb\x90\x00Xing", b"VBRI"])
def test_payloads_that_look_like_tags(mark):
    for n in (64, 128, 192, 1408, 1472, 2880):
        for at in {0, max(0, n - 128), max(0, n - 32), n - len(mark), max(0, n - 160), n // 2}:
            data = bytearray(b"a" * n)
            data[at : at + len(mark)] = mark
            data = bytes(data[:n])
            back, found = media.unpack(media.pack(data))
            assert back == data and found.lost == found.crc_errors == 0
