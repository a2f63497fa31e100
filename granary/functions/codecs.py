"""Compressed payloads: deflate with its size in front, and the archive's runs and matches.

A payload is one value and must fit in a task. Null stays null; bytes that can't be read raise no error and give null.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# fixed values of the deflate wrapping: marks, bytes tried first, and the size from which they are
RAW, DEFLATED = 0, 1
PROBE, PROBE_FROM = 32 << 10, 64 << 10
# fixed values of the archive: version, kinds, version of the compressor, shortest and longest match, furthest match
ARCHIVE, STORED, MATCHED, COMPRESSOR = 1, 0, 2, 1
SHORTEST, LONGEST, FURTHEST = 4, 258, 65535


def _deflated(data: bytes, level: int) -> bytes:
    """Raw deflate, without head or checksum."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def wrap(data: bytes, level: int = 6) -> bytes:
    """Size, mark and deflated bytes where that saves anything (a long payload's first bytes are tried first), else the bytes as they are."""
    if len(data) >= PROBE_FROM and len(_deflated(data[:PROBE], level)) >= PROBE:
        return data
    packed = _deflated(data, level)
    return struct.pack("<QB", len(data), DEFLATED) + packed if len(packed) < len(data) else data


def unwrap(payload: bytes) -> bytes | None:
    """The bytes of a wrapped payload; null if it is too short, of another mark, broken, or not of its size."""
    if len(payload) < 9:
        return None
    size, mark = struct.unpack_from("<QB", payload)
    if mark == RAW:
        return payload[9:]
    if mark != DEFLATED or size >= 1 << 32:
        return None
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(payload[9:], size + 1)
    except zlib.error:
        return None
    return out if len(out) == size else None


def plain(payload: bytes) -> bytes:
    """What a stored payload stands for: itself, unless it reads as a wrapped one of a size above 0."""
    found = unwrap(payload) if len(payload) >= 9 and payload[8] == DEFLATED and any(payload[:8]) else None
    return payload if found is None else found


def _length(n: int) -> bytes:
    """What a length has beyond the 15 of its half byte."""
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def _same(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and from b are equal, up to a limit; by doubling and halving of slices."""
    low = 0
    step = SHORTEST
    while low < most and data[a + low : a + min(low + step, most)] == data[b + low : b + min(low + step, most)]:
        low = min(low + step, most)
        step *= 2
    while low < most and data[a + low] == data[b + low]:
        low += 1
    return low


def pack(data: bytes) -> bytes:
    """An archive of runs and matches, each match with the last place of its first four bytes; stored if that saves nothing."""
    if not data:
        return b""
    out, seen, begin, at = bytearray(), {}, 0, 0
    while at + SHORTEST <= len(data):
        key = data[at : at + SHORTEST]
        last = seen.get(key)
        seen[key] = at
        if last is None or at - last > FURTHEST:
            at += 1
            continue
        n = _same(data, last, at, min(LONGEST, len(data) - at))
        run, over = at - begin, n - SHORTEST
        out += bytes([min(run, 15) << 4 | min(over, 15)]) + _length(run) + data[begin:at] + struct.pack("<H", at - last) + _length(over)
        begin = at = at + n
    if run := len(data) - begin:
        out += bytes([min(run, 15) << 4]) + _length(run) + data[begin:]
    if len(out) + 12 >= len(data):
        return struct.pack("<BBI", ARCHIVE, STORED, len(data)) + data
    return struct.pack("<BBIBBI", ARCHIVE, MATCHED, len(out), COMPRESSOR, 0, len(data)) + bytes(out)


def unpack(payload: bytes) -> bytes | None:
    """The bytes of an archive; null if its head is unknown or a run or match leaves what is there."""
    if not payload:
        return b""
    if len(payload) < 6 or payload[0] != ARCHIVE:
        return None
    kind, size = struct.unpack_from("<BI", payload, 1)
    if kind == STORED:
        return payload[6 : 6 + size] if len(payload) >= 6 + size else None
    if kind != MATCHED or len(payload) < 12 + size:
        return None
    want, body, out = struct.unpack_from("<I", payload, 8)[0], payload[12 : 12 + size], bytearray()
    at = 0

    def more(n: int) -> int:
        nonlocal at
        while n >= 15:
            n += body[at]
            at += 1
            if body[at - 1] < 255:
                break
        return n

    try:
        while at < size and len(out) < want:
            half = body[at]
            at += 1
            run = more(half >> 4)
            if at + run > size:
                return None
            out += body[at : at + run]
            at += run
            if at >= size:
                break
            back = body[at] | body[at + 1] << 8
            at += 2
            n = more(half & 15) + SHORTEST
            if not 0 < back <= len(out):
                return None
            tail = bytes(out[-back:])
            out += (tail * -(-n // back))[:n]
    except IndexError:
        return None
    return bytes(out) if len(out) == want else None


def _column(fn):
    return F.pandas_udf(lambda s: pd.Series([None if x is None else fn(bytes(x)) for x in s], dtype=object), BinaryType())


wrapped, unwrapped, restored, packed, unpacked = (_column(fn) for fn in (wrap, unwrap, plain, pack, unpack))
