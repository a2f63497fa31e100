"""Config files: a 64-byte header, a schema block, a string pool, a value tree and checksums.

Header checks and block slices are column expressions; value trees are read with one task's memory for one file.
Checksums other than CRC32 aren't computed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.binary import first_fault, piece, unsigned

# fixed values: type codes, and limits
NULL, FALSE, TRUE, INT, UINT, FLOAT, TEXT, POOLED, BYTES, ARRAY, OBJECT = 0x00, 0x01, 0x02, 0x10, 0x11, 0x12, 0x20, 0x21, 0x22, 0x30, 0x40
NAMES = {NULL: "null", FALSE: "bool", TRUE: "bool", INT: "i64", UINT: "u64", FLOAT: "f64", TEXT: "string", POOLED: "string", BYTES: "bytes", ARRAY: "array", OBJECT: "object"}
MAX_FILE, MAX_FIELDS, MAX_ELEMENTS, MAX_TEXT, MAX_DEPTH = 256 << 20, 65_536, 1_000_000, 16 << 20, 32


class Fault(ValueError):
    """A refusal: code and offset."""

    def __init__(self, code: str, offset: int):
        super().__init__(f"{code} at {offset}")
        self.code, self.offset = code, offset


class Unsigned(int):
    """A number that is written as unsigned."""


@dataclass(frozen=True)
class Field:
    """A field of a schema; names of numbers and booleans aren't written. Elements of arrays have a schema of their own."""

    id: int
    kind: int
    name: str = ""
    elements: Sequence[Field] = ()


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _schema(fields: Sequence[Field]) -> bytes:
    if len(fields) > MAX_FIELDS:
        raise Fault("LimitExceeded", 0)
    out = [varint(len(fields))]
    for f in fields:
        out += [varint(f.id), bytes([f.kind])]
        if f.kind >= 0x1C:
            name = f.name.encode()
            out += [varint(len(name)), name]
        if f.kind == ARRAY:
            out.append(_schema(f.elements))
    return b"".join(out)


def _value(v: Any) -> bytes:
    if v is None:
        return bytes([NULL])
    if isinstance(v, bool):
        return bytes([TRUE if v else FALSE])
    if isinstance(v, Unsigned):
        return bytes([UINT]) + struct.pack("<Q", v)
    if isinstance(v, int):
        return bytes([INT]) + struct.pack("<q", v)
    if isinstance(v, float):
        if v != v:
            raise Fault("InvalidFloat", 0)
        return bytes([FLOAT]) + struct.pack("<d", v + 0.0)
    if isinstance(v, (str, bytes)):
        raw = v.encode() if isinstance(v, str) else v
        if len(raw) > MAX_TEXT:
            raise Fault("LimitExceeded", 0)
        return bytes([TEXT if isinstance(v, str) else BYTES]) + varint(len(raw)) + raw
    if isinstance(v, Mapping):
        if len(v) > MAX_FIELDS:
            raise Fault("LimitExceeded", 0)
        return bytes([OBJECT]) + varint(len(v)) + b"".join(varint(k) + _value(v[k]) for k in sorted(v))
    if len(v) > MAX_ELEMENTS:
        raise Fault("LimitExceeded", 0)
    return bytes([ARRAY]) + varint(len(v)) + b"".join(map(_value, v))


def encode(root: Mapping[int, Any], fields: Sequence[Field], crc: bool = True) -> bytes:
    """A file of version 2; fields go by ascending id, minus zero becomes zero, NaN is refused."""
    schema, data = _schema(fields), _value(root)
    end = 64 + len(schema) + len(data)
    size = end + 4 * crc
    if size > MAX_FILE:
        raise Fault("LimitExceeded", 8)
    head = struct.pack("<4sBBH10I16x", b"ICFG", 2, int(crc), 0, size, 64, len(schema), 0, 0, 64 + len(schema), len(data), end * crc, 0, 0)
    whole = head + schema + data
    return whole + (struct.pack("<I", zlib.crc32(whole)) if crc else b"")


def files(df: DataFrame, path: str, columns: Sequence[str], crc: bool = True) -> DataFrame:
    """(path, content): a file for each row, its columns as fields 0, 1, ..."""
    kinds = {"string": TEXT, "binary": BYTES, "boolean": TRUE, "double": FLOAT}
    fields = [Field(i, kinds.get(dict(df.dtypes)[c], INT), c) for i, c in enumerate(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)
            made = [encode(dict(enumerate(r)), fields, crc) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return df.select(F.col(path).cast("string").alias("path"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, "path string, content binary")


class _Reader:
    def __init__(self, raw: bytes, at: int, end: int):
        self.raw, self.at, self.end = raw, at, end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise Fault("BoundsViolation", self.at)
        self.at += n
        return self.raw[self.at - n : self.at]

    def varint(self) -> int:
        """Minimal, and below 2^32."""
        start, n = self.at, 0
        for i in range(5):
            b = self.take(1)[0]
            n |= (b & 127) << 7 * i
            if b < 128:
                if i and not b or n >> 32:
                    raise Fault("NonMinimalVarint", start)
                return n
        raise Fault("NonMinimalVarint", start)

    def text(self) -> str:
        start = self.at
        n = self.varint()
        if n > MAX_TEXT:
            raise Fault("LimitExceeded", start)
        try:
            return self.take(n).decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            raise Fault("InvalidString", start) from None

    def schema(self, version: int) -> list[Field]:
        out: list[Field] = []
        for _ in range(self.varint()):
            start = self.at
            ident, kind = self.varint(), self.take(1)[0]
            if out and ident <= out[-1].id:
                raise Fault("FieldOrderViolation", start)
            if kind not in NAMES:
                raise Fault("InvalidTypeCode", start)
            name = self.text() if kind >= 0x1C else ""
            out.append(Field(ident, kind, name, self.schema(version) if kind == ARRAY and version > 1 else ()))
        return out

    def values(self, path: str, depth: int = 0) -> Iterator[tuple[str, str, str | None]]:
        """(path, kind, value as text) of a value and what is in it, in file order."""
        start = self.at
        if depth > MAX_DEPTH:
            raise Fault("RecursionLimitExceeded", start)
        kind = self.take(1)[0]
        if kind in (ARRAY, OBJECT):
            n = self.varint()
            if n > (MAX_ELEMENTS if kind == ARRAY else MAX_FIELDS):
                raise Fault("LimitExceeded", start)
            yield path, NAMES[kind], str(n)
            last = -1
            for i in range(n):
                at = self.at
                step = f"[{i}]" if kind == ARRAY else f".{(ident := self.varint())}"
                if kind == OBJECT:
                    if ident <= last:
                        raise Fault("FieldOrderViolation", at)
                    last = ident
                yield from self.values(path + step, depth + 1)
            return
        if kind not in NAMES or kind == POOLED:
            raise Fault("InvalidTypeCode", start)
        if kind == NULL:
            got = None
        elif kind in (FALSE, TRUE):
            got = "true" if kind == TRUE else "false"
        elif kind == FLOAT:
            x = struct.unpack("<d", self.take(8))[0]
            if x != x:
                raise Fault("InvalidFloat", start)
            got = repr(x)
        elif kind in (INT, UINT):
            got = str(int.from_bytes(self.take(8), "little", signed=kind == INT))
        elif kind == TEXT:
            got = self.text()
        else:
            got = self.take(self.varint()).hex()
        yield path, NAMES[kind], got


def _checked(raw: bytes) -> list[tuple[str, str, str | None]]:
    """All values of a file whose header is right, or the first fault of its schema, values or checksum."""
    size_schema, at_data, size_data = (struct.unpack_from("<I", raw, o)[0] for o in (16, 28, 32))
    schema = _Reader(raw, 64, 64 + size_schema)
    schema.schema(raw[4])
    data = _Reader(raw, at_data, at_data + size_data)
    out = list(data.values("$"))
    if data.at != data.end:
        raise Fault("BoundsViolation", data.at)
    if raw[5] & 1 and zlib.crc32(raw[: at_data + size_data]) != struct.unpack_from("<I", raw, at_data + size_data)[0]:
        raise Fault("Crc32Mismatch", at_data + size_data)
    return out


def header_fault(content: Column) -> Column:
    """(code, offset) of the first header check that fails."""
    u32 = lambda o: unsigned(content, o, 4)
    flags, size = unsigned(content, 5, 1), F.octet_length(content)
    crc_on, hash_on = flags.bitwiseAND(F.lit(1)) != 0, flags.bitwiseAND(F.lit(2)) != 0
    schema, schema_size, pool, pool_size, data, data_size, crc, digest = (u32(o) for o in range(12, 44, 4))
    end = data + data_size
    pool_at = F.when(pool > 0, pool).otherwise(data)
    pool_end = F.when(pool > 0, pool + pool_size).otherwise(data)
    ordered = (schema_size > 0) & (schema + schema_size <= pool_at) & (pool_at <= pool_end) & (pool_end <= data)
    expected = end + F.when(crc_on, 4).otherwise(0) + F.when(hash_on, 32).otherwise(0)
    return first_fault(
        [
            (size < 64, "TruncatedFile", 0),
            (F.hex(piece(content, 0, 4)) != b"ICFG".hex().upper(), "InvalidMagic", 0),
            (~unsigned(content, 4, 1).isin(1, 2), "InvalidVersion", 4),
            (flags > 7, "InvalidFlags", 5),
            (unsigned(content, 6, 2) != 0, "ReservedFieldNonzero", 6),
            (u32(44) != 0, "ReservedFieldNonzero", 44),
            (F.hex(piece(content, 48, 16)).rlike("[^0]"), "ReservedFieldNonzero", 48),
            (crc_on != (crc != 0), "FlagMismatch", 5),
            (hash_on != (digest != 0), "FlagMismatch", 5),
            ((schema == 0) | (schema_size == 0), "BoundsViolation", 12),
            ((data == 0) | (data_size == 0), "BoundsViolation", 28),
            (~ordered, "BoundsViolation", 12),
            ((crc > 0) & (end > crc), "BoundsViolation", 36),
            ((digest > 0) & (F.when(crc > 0, crc + 4).otherwise(end) > digest), "BoundsViolation", 40),
            (u32(8) != expected, "BoundsViolation", 8),
            (size != u32(8), "TruncatedFile", 0),
        ]
    )


def blocks(files: DataFrame) -> DataFrame:
    """(path, fault, schema, pool, data, crc32) of each file; the slices are null where the header is wrong."""
    ok = F.col("fault.code") == "Ok"
    c = F.col("content")
    cut = lambda at, size: F.when(ok, piece(c, unsigned(c, at, 4), unsigned(c, size, 4)))
    return files.withColumn("fault", header_fault(c)).select("path", "fault", cut(12, 16).alias("schema"), cut(20, 24).alias("pool"), cut(28, 32).alias("data"), F.when(ok & (unsigned(c, 36, 4) > 0), unsigned(c, unsigned(c, 36, 4), 4)).alias("crc32"))


def values(files: DataFrame) -> DataFrame:
    """(path, at, kind, value) of all values; a file with a fault gives one row of kind fault, with its code and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw, code, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if code != "Ok":
                        raise Fault(code, offset)
                    rows = _checked(raw)
                except Fault as f:
                    rows = [("$", "fault", f"{f.code} {f.offset}")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names=["path", "at", "kind", "value"])

    fault = header_fault(F.col("content"))
    rows = files.select("path", F.coalesce("content", F.unhex(F.lit(""))).alias("content")).select("path", "content", fault.getField("code").alias("code"), fault.getField("offset").alias("offset"))
    return rows.mapInArrow(run, "path string, at string, kind string, value string")
