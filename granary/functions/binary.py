"""Numbers and slices of binary columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def piece(content: Column, offset: Column | int, size: Column | int) -> Column:
    """Bytes from an offset counted from 0."""
    return F.substring(content, (_at(offset) + 1).cast("int"), _at(size).cast("int"))


def unsigned(content: Column, offset: Column | int, size: int) -> Column:
    """The little-endian number of some bytes: long below eight bytes, else decimal(20, 0)."""
    shown = F.array_join(F.reverse(F.regexp_extract_all(F.hex(piece(content, offset, size)), F.lit("(..)"), F.lit(1))), "")
    return F.conv(shown, 16, 10).cast("decimal(20,0)" if size == 8 else "long")


def first_fault(tests: Sequence[tuple[Column, str, int]]) -> Column:
    """(code, offset) of the first test that holds, Ok at 0 if none does."""
    make = lambda code, offset: F.struct(F.lit(code).alias("code"), F.lit(offset).cast("long").alias("offset"))
    out = make("Ok", 0)
    for test, code, offset in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), make(code, offset)).otherwise(out)
    return out
