"""Update packages: a header, a table of chunks, a manifest with dependencies and an apply order, and payloads.

Reading is column expressions: tables are exploded by their entries, and the rules are joins and running values.
Signatures, sequences and BLAKE3 hashes are not written or checked.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.binary import first_fault, piece, unsigned
from granary.operators.ordered import running
from granary.operators.staging import staged

# fixed values: magics, sizes, profiles that may be opened
MAGICS, HEAD, ENTRY, MANIFEST, MAX_CHUNKS = (b"IUPD", b"UPD1"), {1: 36, 2: 37}, 56, 24, 1_000_000
PROFILES, ALLOWED = range(5), (2, 3, 4)


def encode(chunks: Sequence[bytes], edges: Sequence[tuple[int, int]] = (), order: Sequence[int] | None = None, profile: int | None = None) -> bytes:
    """A package: version 1 without a profile, else 2. Payloads lie in apply order."""
    order = range(len(chunks)) if order is None else order
    version = 1 if profile is None else 2
    at_table = HEAD[version]
    at_manifest = at_table + ENTRY * len(chunks)
    size = MANIFEST + 8 * len(edges) + 4 * len(order) + 8
    at_payload = at_manifest + size
    starts, at = {}, at_payload
    for i in (*order, *range(len(chunks))):
        if 0 <= i < len(chunks) and i not in starts:
            starts[i], at = at, at + len(chunks[i])
    table = b"".join(struct.pack("<IQQI32x", i, len(c), starts.get(i, at_payload), zlib.crc32(c)) for i, c in enumerate(chunks))
    manifest = struct.pack("<B3xIIIQ", version, 0, len(edges), len(order), size) + b"".join(struct.pack("<II", *e) for e in edges) + b"".join(struct.pack("<I", i) for i in order)
    manifest += struct.pack("<Q", zlib.crc32(manifest))
    head = MAGICS[0] + bytes([version]) + (b"" if profile is None else bytes([profile])) + struct.pack("<IHBQQQ", 0, at_table, 0, at_table, at_manifest, at_payload)
    return head + table + manifest + b"".join(chunks[i] for i in starts)


def files(df: DataFrame, profile: int | None = None) -> DataFrame:
    """(path, content) from (path, chunks array<binary>, places array<int>): chunks in the order of their places; each depends on the one applied before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for chunks, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                made.append(encode(chunks, list(zip(places[1:], places[:-1], strict=True)), places, profile))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return df.select(F.col("path").cast("string"), "chunks", "places").mapInArrow(run, "path string, content binary")


def _layout(content: Column) -> dict[str, Column]:
    more = F.when(unsigned(content, 4, 1) == 2, 1).otherwise(0)
    u64 = lambda o: unsigned(content, F.lit(o) + more, 8).cast("long")
    return {"table": u64(12), "manifest": u64(20), "payload": u64(28), "head": more + 36, "more": more}


def header_fault(content: Column) -> Column:
    """(code, offset) of the first header check that fails; offsets are those of version 2."""
    x, size = _layout(content), F.octet_length(content)
    version, profile = unsigned(content, 4, 1), unsigned(content, 5, 1)
    two, m = version == 2, x["manifest"]
    edges, order, stated = unsigned(content, m + 8, 4), unsigned(content, m + 12, 4), unsigned(content, m + 16, 8)
    table = m - x["table"]
    return first_fault(
        [
            (size < 5, "OffsetOutOfBounds", 0),
            (~F.hex(piece(content, 0, 4)).isin(*(g.hex().upper() for g in MAGICS)), "InvalidMagic", 0),
            (~version.isin(*HEAD), "UnsupportedVersion", 4),
            (size < x["head"], "OffsetOutOfBounds", 0),
            (two & ~profile.isin(*PROFILES), "InvalidFlags", 5),
            (two & ~profile.isin(*ALLOWED), "ProfileNotAllowed", 5),
            (unsigned(content, x["more"] + 5, 4) != 0, "InvalidFlags", 6),
            (unsigned(content, x["more"] + 9, 2) != x["head"], "InvalidHeaderSize", 10),
            (unsigned(content, x["more"] + 11, 1) != 0, "InvalidHeaderSize", 12),
            (x["table"] < x["head"], "OffsetOutOfBounds", 13),
            (m <= x["table"], "OffsetOutOfBounds", 21),
            ((x["payload"] <= m) | (x["payload"] > size), "OffsetOutOfBounds", 29),
            (F.pmod(table, F.lit(ENTRY)) != 0, "InvalidChunkTableSize", 13),
            (table / ENTRY > MAX_CHUNKS, "OffsetOutOfBounds", 13),
            (m + MANIFEST > size, "OffsetOutOfBounds", 21),
            (unsigned(content, m, 1) != version, "InvalidManifestVersion", 21),
            (F.hex(piece(content, m + 1, 3)) != "000000", "InvalidHeaderSize", 22),
            (stated != edges * 8 + order * 4 + MANIFEST + 8, "ManifestSizeMismatch", 37),
            (m + stated > size, "OffsetOutOfBounds", 21),
        ]
    )


def _judged(files: DataFrame) -> DataFrame:
    """Files with __code, the fault of their header, and the offsets of their parts; staged, as every table of a file needs them."""
    c = F.col("content")
    judged = files.withColumn("__code", header_fault(c).getField("code"))
    return staged(judged.withColumns({f"__{k}": F.when(F.col("__code") == "Ok", v) for k, v in _layout(c).items()}), "judged")


def _opened(files: DataFrame) -> DataFrame:
    return (files if "__code" in files.columns else _judged(files)).where("__code = 'Ok'")


def _each(df: DataFrame, n: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))))


def chunks(files: DataFrame) -> DataFrame:
    """(path, entry, chunk, size, start, crc32, payload) of the chunk tables."""
    c, at = F.col("content"), F.col("__table") + F.col("entry") * ENTRY
    rows = _each(_opened(files), F.floor((F.col("__manifest") - F.col("__table")) / ENTRY), "entry")
    rows = rows.select("path", "entry", "content", "__payload", unsigned(c, at, 4).alias("chunk"), unsigned(c, at + 4, 8).cast("long").alias("size"), unsigned(c, at + 12, 8).cast("long").alias("start"), unsigned(c, at + 20, 4).alias("crc32"))
    inside = (F.col("start") >= F.col("__payload")) & (F.col("start") + F.col("size") <= F.octet_length("content"))
    return rows.select("path", "entry", "chunk", "size", "start", "crc32", F.when(inside, piece(c, F.col("start"), F.col("size"))).alias("payload"))


def edges(files: DataFrame) -> DataFrame:
    """(path, edge, source, target) of the dependencies."""
    c, at = F.col("content"), F.col("__manifest") + MANIFEST + F.col("edge") * 8
    rows = _each(_opened(files), unsigned(c, F.col("__manifest") + 8, 4), "edge")
    return rows.select("path", "edge", unsigned(c, at, 4).alias("source"), unsigned(c, at + 4, 4).alias("target"))


def order(files: DataFrame) -> DataFrame:
    """(path, place, chunk) of the apply order."""
    c, m = F.col("content"), F.col("__manifest")
    rows = _each(_opened(files), unsigned(c, m + 12, 4), "place")
    return rows.select("path", "place", unsigned(c, m + MANIFEST + unsigned(c, m + 8, 4) * 8 + F.col("place") * 4, 4).alias("chunk"))


def applied(files: DataFrame) -> DataFrame:
    """(path, place, chunk, payload) in apply order."""
    files = _judged(files)
    return order(files).join(chunks(files).select("path", F.col("entry").alias("chunk"), "payload"), ["path", "chunk"])


def faults(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, code): the first fault of each file: header, chunk table, overlaps, dependencies, apply order, then with strict the checksums."""
    files = _judged(files)
    head = files.select("path", F.col("__code").alias("code"), F.lit(0).alias("rank"))
    table = staged(chunks(files), "chunks")
    n = table.groupBy("path").agg(F.count("*").alias("n"))
    found = [head.where("code <> 'Ok'").select("path", "rank", F.lit(0).cast("long").alias("at"), "code")]
    add = lambda df, rank, at, code: found.append(df.select("path", F.lit(rank).alias("rank"), F.col(at).cast("long").alias("at"), F.lit(code).alias("code")))
    add(table.where("chunk <> entry"), 1, "entry", "ChunkIndexError")
    add(table.where("payload is null"), 1, "entry", "OffsetOutOfBounds")
    near = running(table.select("path", "start", "entry", (F.col("start") + F.col("size")).alias("end")), ["path"], ["start", "entry"], lags=["end"])
    add(near.where("last_end > start"), 2, "start", "OverlappingPayloads")
    ends = edges(files).join(n, "path", "left").where("n is null or source >= n or target >= n or source = target")
    add(ends, 3, "edge", "InvalidDependency")
    placed = order(files)
    counts = n.join(placed.groupBy("path").agg(F.count("*").alias("listed")), "path", "left").where("n <> coalesce(listed, 0)")
    add(counts, 4, "n", "MissingChunkInApplyOrder")
    add(placed.join(n, "path", "left").where("n is null or chunk >= n"), 5, "place", "MissingChunkInApplyOrder")
    twice = placed.groupBy("path", "chunk").agg(F.count("*").alias("c"), F.max("place").alias("place")).where("c > 1")
    add(twice, 5, "place", "DuplicateChunkInApplyOrder")
    if strict:
        add(table.where(F.crc32("payload") != F.col("crc32")), 6, "entry", "Crc32Mismatch")
        c, m = F.col("content"), F.col("__manifest")
        size = unsigned(c, m + 16, 8).cast("long")
        manifest = _opened(files).where(F.crc32(piece(c, m, size - 8)) != unsigned(c, m + size - 8, 4))
        add(manifest.withColumn("one", F.lit(0)), 7, "one", "Crc32Mismatch")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = every.groupBy("path").agg(F.min(F.struct("rank", "at", "code")).getField("code").alias("code"))
    return files.select("path").join(first, "path", "left").select("path", F.coalesce("code", F.lit("Ok")).alias("code"))
