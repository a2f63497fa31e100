"""Quality rules: counts over words and lines, then compression bands.

A text that the base rules pass is held against bands of zstandard ratios (compressed bytes over bytes): the whole
text against a band of its length, and its fixed chunks with the rest at the end against bands of theirs, of which a
share outside rejects.

Null and empty texts have no words, so the base rules reject them. Rows are independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BLANKS, arrow_map, texts_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
_BLANK_TABLE = str.maketrans(BLANKS, " " * len(BLANKS))


# fixed values: (bytes below which it holds, lowest, highest) for steps of a fifth in length; the ratios of the rows of the
# training fold of sf0.1 that are labelled good, and 0.01 more on both sides; longer texts than 20 KB are few there, so their limits are wide
WHOLE = (
    (60, 0.799, 1.219), (72, 0.799, 1.219), (86, 0.799, 1.163), (103, 0.793, 1.144), (124, 0.692, 1.105), (149, 0.665, 1.105),
    (179, 0.654, 0.933), (214, 0.635, 0.834), (257, 0.613, 0.834), (309, 0.601, 0.754), (371, 0.592, 0.735), (445, 0.602, 0.711),
    (534, 0.564, 0.692), (641, 0.566, 0.692), (770, 0.517, 0.689), (924, 0.506, 0.632), (1109, 0.494, 0.595), (1331, 0.485, 0.59),
    (1597, 0.472, 0.565), (1916, 0.456, 0.553), (2300, 0.459, 0.536), (2760, 0.458, 0.53), (3312, 0.454, 0.511), (3974, 0.443, 0.498),
    (4769, 0.437, 0.484), (5723, 0.43, 0.477), (6868, 0.421, 0.475), (8242, 0.417, 0.464), (9890, 0.417, 0.459), (11868, 0.41, 0.456),
    (14242, 0.406, 0.451), (17091, 0.4, 0.449), (20509, 0.4, 0.449), (float("inf"), 0.25, 0.6),
)
CHUNK = (
    (60, 0.905, 1.275), (72, 0.86, 1.18), (86, 0.792, 1.158), (103, 0.792, 1.047), (124, 0.734, 0.952), (149, 0.719, 0.869),
    (179, 0.684, 0.855), (214, 0.642, 0.814), (257, 0.642, 0.773), (309, 0.619, 0.762), (371, 0.589, 0.729), (445, 0.578, 0.699),
    (534, 0.58, 0.689), (641, 0.559, 0.691), (770, 0.53, 0.632), (924, 0.512, 0.607), (1109, 0.503, 0.581), (1331, 0.486, 0.559),
    (1597, 0.479, 0.553), (1916, 0.461, 0.548), (2300, 0.457, 0.539), (2760, 0.457, 0.539), (3312, 0.457, 0.539), (3974, 0.457, 0.539),
    (4769, 0.457, 0.539), (5723, 0.457, 0.539), (6868, 0.457, 0.539), (8242, 0.457, 0.539), (9890, 0.457, 0.539), (11868, 0.457, 0.539),
    (14242, 0.457, 0.539), (17091, 0.457, 0.539), (20509, 0.457, 0.539), (float("inf"), 0.457, 0.539),
)


@dataclass(frozen=True)
class Bands:
    """Limits on ratios by length, calibrated on labelled rows; the last of them has no upper length."""

    whole: tuple[tuple[float, float, float], ...] = WHOLE
    chunk_bytes: int = 2048
    chunk: tuple[tuple[float, float, float], ...] = CHUNK
    bad_chunks: float = 0.5
    level: int = 3


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_BLANK_TABLE).split(" ") if w]


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows are compared exactly, by pairwise ranks."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    code = ids
    for k in range(1, window):
        code = code[:-1] * len(seen) + ids[k:]
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def in_bands(raw: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The whole ratio (nan if outside its band) and the share of chunks outside the chunk band."""

    def measured(part: bytes, table: tuple[tuple[float, float, float], ...]) -> tuple[float, bool]:
        ratio = len(z.compress(part)) / max(1, len(part))
        low, high = next((a, b) for size, a, b in table if len(part) < size)
        return ratio, low <= ratio <= high

    ratio, good = measured(raw, bands.whole)
    step = bands.chunk_bytes
    # a text of one chunk is judged as a whole
    parts = [raw[i : i + step] for i in range(0, len(raw), step)] if len(raw) > step else []
    bad = sum(not measured(p, bands.chunk)[1] for p in parts)
    return (ratio if good else float("nan")), bad / max(1, len(parts))


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, counts, base_failed and kept, and further columns of the row."""
    bands = bands or Bands()
    kind = df.select(id_col).dtypes[0][1]
    schema = f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    schema += "".join(f", `{c}` {k}" for c, k in df.select(*also).dtypes)

    def make():
        z = zstandard.ZstdCompressor(level=bands.level)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in texts_of(batch.column(1)):
                words = words_of(t)
                repeated = repeat_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
                kept = False
                if not failed:
                    ratio, bad = in_bands(t.encode("utf-8", "surrogatepass"), bands, z)
                    kept = ratio == ratio and bad <= bands.bad_chunks
                rows.append((len(words), sum(map(len, words)), sum(map(t.count, SYMBOLS)), dup_lines(t), repeated, failed, kept))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:]]
            names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays, *batch.columns[2:]], names=[*names, *also])

        return step

    return arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *also), schema, make)
