"""Faults of all formats under one set of categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: by format, the category and the common number of each fault
CONFIG = {
    "TruncatedFile": ("Truncated", 0x01), "InvalidMagic": ("InvalidMagic", 0x02), "InvalidVersion": ("UnsupportedVersion", 0x03), "InvalidFlags": ("CorruptData", 0x04),
    "ReservedFieldNonzero": ("CorruptData", 0x05), "FlagMismatch": ("CorruptData", 0x06), "BoundsViolation": ("Truncated", 0x07), "ArithmeticOverflow": ("CorruptData", 0x08),
    "TruncatedBlock": ("Truncated", 0x09), "Crc32Mismatch": ("InvalidChecksum", 0x07), "Blake3Mismatch": ("InvalidChecksum", 0x08), "InvalidSchema": ("SchemaError", 0x20),
    "FieldOrderViolation": ("SchemaError", 0x21), "InvalidString": ("CorruptData", 0x22), "InvalidTypeCode": ("CorruptData", 0x23), "FieldTypeMismatch": ("SchemaError", 0x24),
    "MissingRequiredField": ("SchemaError", 0x25), "UnknownField": ("SchemaError", 0x26), "FieldCountMismatch": ("SchemaError", 0x27), "ArrayTypeMismatch": ("SchemaError", 0x28),
    "NonMinimalVarint": ("CorruptData", 0x29), "InvalidFloat": ("CorruptData", 0x2A), "RecursionLimitExceeded": ("CorruptData", 0x2B), "LimitExceeded": ("CorruptData", 0x2C),
}
PACKAGE = {
    "InvalidMagic": ("InvalidMagic", 0x01), "UnsupportedVersion": ("UnsupportedVersion", 0x02), "InvalidFlags": ("CorruptData", 0x03), "InvalidHeaderSize": ("CorruptData", 0x04),
    "OffsetOutOfBounds": ("Truncated", 0x05), "Crc32Mismatch": ("InvalidChecksum", 0x06), "Blake3Mismatch": ("InvalidChecksum", 0x07), "InvalidChunkTableSize": ("ManifestError", 0x60),
    "ChunkIndexError": ("ManifestError", 0x61), "OverlappingPayloads": ("ManifestError", 0x62), "EmptyChunk": ("ManifestError", 0x63), "InvalidManifestVersion": ("ManifestError", 0x64),
    "ManifestSizeMismatch": ("ManifestError", 0x65), "MissingChunk": ("ManifestError", 0x66), "CyclicDependency": ("DependencyError", 0x68), "InvalidDependency": ("DependencyError", 0x69),
    "MissingChunkInApplyOrder": ("DependencyError", 0x6A), "DuplicateChunkInApplyOrder": ("DependencyError", 0x6B), "ApplyError": ("PolicyViolation", 0x6C), "UnknownError": ("Unknown", 0x7F),
}
LOG = {
    "InvalidMagic": ("InvalidMagic", 0x01), "UnsupportedVersion": ("UnsupportedVersion", 0x02), "RecordTruncated": ("Truncated", 0x05), "Crc32Mismatch": ("InvalidChecksum", 0x06),
    "Blake3Mismatch": ("InvalidChecksum", 0x07), "CompressionFailed": ("CompressionError", 0x40), "CorruptedHeader": ("CorruptData", 0x41), "MissingLayer": ("CorruptData", 0x42),
    "MalformedBlock": ("CorruptData", 0x43), "BlockOutOfBounds": ("Truncated", 0x44), "InvalidBlockType": ("CorruptData", 0x45), "SchemaValidation": ("SchemaError", 0x46),
    "OutOfBoundsRef": ("Truncated", 0x47), "DictLookup": ("CorruptData", 0x48), "VarintDecode": ("CorruptData", 0x49), "DepthLimit": ("CorruptData", 0x4A),
    "FileSizeLimit": ("Truncated", 0x4B), "RecordCountLimit": ("CorruptData", 0x4C), "StringLengthLimit": ("CorruptData", 0x4D), "CriticalFlag": ("CorruptData", 0x4E),
}
FORMATS = {"config": CONFIG, "package": PACKAGE, "log": LOG}
NONE, UNKNOWN = ("None", 0x00), ("Unknown", 0xFF)


def category_of(name: str, code: Column) -> Column:
    """(category, number) of a fault of a format; Unknown for a code the format doesn't have, null for null."""
    make = lambda x: F.struct(F.lit(x[0]).alias("category"), F.lit(x[1]).cast("long").alias("number"))
    known = F.create_map(*(x for k, v in FORMATS[name].items() for x in (F.lit(k), make(v))))
    return F.when(code == "Ok", make(NONE)).when(code.isNotNull(), F.coalesce(F.try_element_at(known, code), make(UNKNOWN)))
