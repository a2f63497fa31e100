"""Values of nested documents by path, without implicit casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(steps: Sequence[str | int]) -> str:
    return "$" + "".join(f".{s}" if isinstance(s, str) else f"[{s}]" for s in steps)


def kind(v: Column, steps: Sequence[str | int]) -> Column:
    """Kind of the value at a path, null if there is none."""
    at = F.try_variant_get(v, _path(steps), "variant") if steps else v
    return F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0)


def navigate(v: Column, steps: Sequence[str | int], want: str) -> Column:
    """Ok, or the first refusal along the path: FieldTypeMismatch, UnknownField for a key, BoundsViolation for an index."""
    tests: list[tuple[Column, str]] = []
    for i, s in enumerate(steps):
        tests.append((kind(v, steps[:i]) != ("OBJECT" if isinstance(s, str) else "ARRAY"), "FieldTypeMismatch"))
        tests.append((kind(v, steps[: i + 1]).isNull(), "UnknownField" if isinstance(s, str) else "BoundsViolation"))
    tests.append((kind(v, steps) != want, "FieldTypeMismatch"))
    out = F.lit("Ok")
    for test, code in reversed(tests):
        out = F.when(test, code).otherwise(out)
    return out


def value_at(v: Column, steps: Sequence[str | int], want: str) -> Column:
    """The value as a string, if navigate says Ok."""
    return F.when(navigate(v, steps, want) == "Ok", F.try_variant_get(v, _path(steps), "string"))
