"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from granary.operators.staging import staged, unstaged

#: Word characters are everything but these six.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java character class, for split().
BLANK_CLASS = "[ \\t\\n\\x0B\\f\\r]+"
#: A sub-batch of whole texts ends once it holds this many characters.
GROUP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor loses nothing."""
    return staged(df, name, "zstd")


drop_written = unstaged


def groups(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], rows: int = 1 << 30) -> DataFrame:
    """mapInArrow with state: make() runs once for each task and gives the function of its batches, cut to some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                if (out := step(b.slice(at, rows))) is not None:
                    yield out
        b = out = step = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker else keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
