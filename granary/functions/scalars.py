"""Scalar functions of structured files, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_byte_ratio(text: Column) -> Column:
    """Share of the 256 byte values that occur in the UTF-8 bytes."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)))) / 256


def clean_float(x: Column) -> Column:
    """Plus zero for minus zero, null for NaN."""
    return F.when(~F.isnan(x), F.when(x == 0, F.lit(0.0)).otherwise(x))


def is_hex(x: Column, digits: int) -> Column:
    return x.rlike(f"^[0-9a-f]{{{digits}}}$")


def size_of_label(label: Column) -> Column:
    """Bytes of 12B, 10KB, 3MB; 0 for anything else."""
    unit = F.regexp_extract(label, r"^[0-9]+(B|KB|MB)$", 1)
    times = F.when(unit == "B", 1).when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).cast("long")
    return F.coalesce(F.regexp_extract(label, "^[0-9]+", 0).try_cast("long") * times, F.lit(0).cast("long"))


def format_of(content: Column, magics: Mapping[str, str]) -> Column:
    """Name of the format whose magic the bytes begin with, else unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("unknown")
    for magic, name in magics.items():
        out = F.when(head == magic.encode().hex().upper(), name).otherwise(out)
    return out


def varint_hex(n: Column) -> Column:
    """Minimal little-endian base 128 of a number below 2^32, as hex."""
    parts = []
    for i in range(5):
        rest = F.shiftright(n, 7 * i)
        byte = rest.bitwiseAND(F.lit(127)).bitwiseOR(F.when(F.shiftright(n, 7 * i + 7) > 0, F.lit(128)).otherwise(F.lit(0)))
        shown = F.lpad(F.hex(byte), 2, "0")
        parts.append(shown if i == 0 else F.when(rest > 0, shown).otherwise(""))
    return F.concat(*parts)


def varint_value(hexes: Column) -> Column:
    """The number of a varint in hex; null if it isn't minimal, doesn't end, or is longer than five bytes."""
    byte = F.transform(F.regexp_extract_all(hexes, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    last = F.get(byte, F.size(byte) - 1)
    ends = (last < 128) & ~F.exists(F.slice(byte, 1, F.greatest(F.size(byte) - 1, F.lit(0))), lambda b: b < 128)
    total = F.aggregate(F.reverse(byte), F.lit(0).cast("long"), lambda acc, b: acc * 128 + b.bitwiseAND(F.lit(127)))
    return F.when((F.size(byte) > 0) & (F.size(byte) <= 5) & ends & ((last > 0) | (F.size(byte) == 1)), total)


def little_endian_hex(n: Column) -> Column:
    """The eight bytes of a number, lowest first, as hex."""
    return F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 16, "0"), F.lit("(..)"), F.lit(1))), "")
