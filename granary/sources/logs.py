"""Log files: a 16-byte header, then blocks of a 72-byte header and a payload.

The walk over blocks is sequential in a file and runs where the file is; everything on its rows is a DataFrame
expression. Profiles that compress, sign or hash with BLAKE3 aren't written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.binary import first_fault, piece, unsigned

# fixed values: magics, sizes, block types, flags of the profiles that are written
FILE, BLOCK, HEAD, BLOCK_HEAD, SLICE = b"ILOG", b"BLK1", 16, 72, 4096
DATA, TOC, INDEX, ARCHIVE = 1, 2, 3, 4
FLAGS = {"MINIMAL": 0x01, "INTEGRITY": 0x03, "SEARCHABLE": 0x09}


def _block(kind: int, payload: bytes, crc: bool, stamp: int) -> bytes:
    return struct.pack("<4sHHQII48x", BLOCK, kind, 0, stamp, len(payload), zlib.crc32(payload) if crc else 0) + payload


def encode(events: bytes, profile: str = "MINIMAL", stamp: int = 0) -> bytes:
    """One data block, its table of contents, and an index of its slices if the profile has one."""
    crc = profile == "INTEGRITY"
    payload = struct.pack("<BIQ", 1, 1, stamp) + events
    data = _block(DATA, payload, crc, stamp)
    index = b""
    if profile == "SEARCHABLE":
        starts = range(0, len(payload), SLICE)
        index = _block(INDEX, struct.pack("<BBI", 1, 0, len(starts)) + b"".join(struct.pack("<II", s, min(SLICE, len(payload) - s)) for s in starts), False, stamp)
    toc = _block(TOC, struct.pack("<BI", 1, 1 + bool(index)), crc, stamp)
    return struct.pack("<4sBBHQ", FILE, 1, FLAGS[profile], 0, HEAD + len(data)) + data + toc + index


def files(df: DataFrame, profile: str = "MINIMAL") -> DataFrame:
    """(path, content) from (path, events binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode(e or b"", profile) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return df.select(F.col("path").cast("string"), "events").mapInArrow(run, "path string, content binary")


def header_fault(content: Column) -> Column:
    """(code, offset) of the first header check that fails."""
    size, toc = F.octet_length(content), unsigned(content, 8, 8)
    return first_fault(
        [
            (size < HEAD, "CorruptedHeader", 0),
            (~F.hex(piece(content, 0, 4)).isin(FILE.hex().upper(), BLOCK.hex().upper()), "InvalidMagic", 0),
            (unsigned(content, 4, 1) != 1, "UnsupportedVersion", 4),
            (unsigned(content, 6, 2) != 0, "CorruptedHeader", 6),
            (toc < HEAD, "CorruptedHeader", 8),
            ((toc + BLOCK_HEAD > size) & (size < HEAD + BLOCK_HEAD), "BlockOutOfBounds", 8),
            (toc + BLOCK_HEAD > size, "CorruptedHeader", 8),
        ]
    )


def blocks(files: DataFrame) -> DataFrame:
    """(path, seq, kind, at, size, crc32, payload) of the blocks of files whose header is right; a block that runs out of its file has a null payload and is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, at = [], HEAD
                while at + BLOCK_HEAD <= len(raw):
                    _, kind, _, _, size, crc = struct.unpack_from("<4sHHQII", raw, at)
                    whole = at + BLOCK_HEAD + size <= len(raw)
                    rows.append({"path": path, "seq": len(rows), "kind": kind, "at": at, "size": size, "crc32": crc, "payload": raw[at + BLOCK_HEAD : at + BLOCK_HEAD + size] if whole else None})
                    if not whole:
                        break
                    at += BLOCK_HEAD + size
                yield pa.RecordBatch.from_pylist(rows, _BLOCKS)

    good = files.where(header_fault(F.col("content")).getField("code") == "Ok").select("path", "content")
    return good.mapInArrow(run, "path string, seq long, kind int, at long, size long, crc32 long, payload binary")


_BLOCKS = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary())])


def first_of(rows: DataFrame, kind: int) -> DataFrame:
    """(path, payload) of the first block of a kind."""
    return rows.where(F.col("kind") == kind).groupBy("path").agg(F.min_by("payload", "seq").alias("payload"))


def events(rows: DataFrame) -> DataFrame:
    """(path, code, events): the first data block without its 13-byte prefix, or why there is none."""
    n, version = F.octet_length("payload"), unsigned(F.col("payload"), 0, 1)
    code = F.when(F.col("payload").isNull(), "BlockOutOfBounds").when(n < 13, "RecordTruncated").when(version != 1, "SchemaValidation").otherwise("Ok")
    found = first_of(rows, DATA).withColumn("code", code)
    paths = rows.select("path").distinct()
    both = paths.join(found, "path", "left")
    return both.select("path", F.coalesce("code", F.lit("MissingLayer")).alias("code"), F.when(F.col("code") == "Ok", F.expr("substring(payload, 14)")).alias("events"))


def index_entries(rows: DataFrame) -> DataFrame:
    """(path, entry, start, size) that the index block stores."""
    p = F.col("payload")
    n = unsigned(p, 2, 4)
    entry = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))
    listed = first_of(rows, INDEX).select("path", "payload", entry.alias("entry"))
    return listed.select("path", "entry", unsigned(p, F.col("entry") * 8 + 6, 4).alias("start"), unsigned(p, F.col("entry") * 8 + 10, 4).alias("size"))


def faults(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, code): the first fault of each file: header, first block, bounds, and with strict the checksums of blocks that have one."""
    head = header_fault(F.col("content"))
    magic = F.hex(piece(F.col("content"), HEAD, 4)) != BLOCK.hex().upper()
    opened = files.select("path", F.when(head.getField("code") != "Ok", head.getField("code")).when(magic, "MalformedBlock").otherwise("Ok").alias("code"))
    crc = unsigned(F.col("content"), 5, 1).bitwiseAND(F.lit(2)) != 0
    wrong = F.when(F.col("payload").isNull(), "BlockOutOfBounds").when(F.lit(strict) & F.col("crc_on") & (F.crc32("payload") != F.col("crc32")), "Crc32Mismatch")
    inside = blocks(files).join(files.select("path", crc.alias("crc_on")), "path").withColumn("wrong", wrong).where("wrong is not null").groupBy("path").agg(F.min_by("wrong", "seq").alias("wrong"))
    return opened.join(inside, "path", "left").select("path", F.when(F.col("code") != "Ok", F.col("code")).otherwise(F.coalesce("wrong", F.lit("Ok"))).alias("code"))
