"""BLAKE3 with its 32-byte output, from the published specification, over many payloads at once.

All chunks of a batch are lanes of one numpy array and each step works on every lane: first the blocks of a chunk one after
another, then the levels of the trees. Memory: a few times the payloads of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# fixed values of the specification: initial words, order of message words, flags
INITIAL = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8

CHUNK, BLOCK, ROUNDS = 1024, 64, 7
#: Bytes hashed in one go, chunks counted whole; a longer payload is a batch of its own.
BATCH_BYTES = 4_000_000


#: The message words of each turn, in order: two for each column, then two for each diagonal.
WORDS = [list(range(16))]
for _ in range(ROUNDS - 1):
    WORDS.append([WORDS[-1][k] for k in ORDER])


def _turn(x: np.ndarray, n: int, spare: np.ndarray) -> None:
    np.left_shift(x, np.uint32(32 - n), out=spare)
    np.right_shift(x, np.uint32(n), out=x)
    np.bitwise_or(x, spare, out=x)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, words: np.ndarray, at: list[int], spare: np.ndarray) -> None:
    """Mixes four quarters of the state (4, lanes) with the words at these places, in place."""
    for some, right, left in ((at[::2], 16, 12), (at[1::2], 8, 7)):
        a += b
        a += words[some]
        d ^= a
        _turn(d, right, spare)
        c += d
        b ^= c
        _turn(b, left, spare)


def _compress(chain: np.ndarray, words: np.ndarray, count: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining words (8, lanes) of chaining words (8, lanes) and message words (16, lanes)."""
    a, b, c = chain[:4].copy(), chain[4:].copy(), np.repeat(INITIAL[:4, None], chain.shape[1], axis=1)
    d, spare, words = np.empty_like(a), np.empty_like(a), np.ascontiguousarray(words)
    d[0], d[1], d[2], d[3] = count & 0xFFFFFFFF, count >> 32, length, flags
    for at in WORDS:
        _mixed(a, b, c, d, words, at[:8], spare)
        # the diagonals are columns once the rows are turned
        b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
        _mixed(a, b, c, d, words, at[8:], spare)
        b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
    return np.concatenate([a ^ c, b ^ d])


def _chunks(payloads: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining words (8, chunks) of all chunks, and the number of chunks of each payload."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    many = np.maximum(1, -(-sizes // CHUNK))
    data = np.frombuffer(b"".join(p + bytes(n * CHUNK - len(p)) for p, n in zip(payloads, many.tolist(), strict=True)), "<u4")
    data = data.reshape(-1, CHUNK // BLOCK, BLOCK // 4)
    owner = np.repeat(np.arange(len(payloads)), many)
    count = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    left = np.minimum(sizes[owner] - count * CHUNK, CHUNK)
    last = np.maximum(0, (left - 1) // BLOCK)
    chain = np.repeat(INITIAL[:, None], len(owner), axis=1)
    for k in range(CHUNK // BLOCK):
        lane = np.flatnonzero(last >= k)
        if not len(lane):
            break
        ends = last[lane] == k
        flags = (CHUNK_START if k == 0 else 0) | np.where(ends, CHUNK_END | np.where(many[owner[lane]] == 1, ROOT, 0), 0)
        chain[:, lane] = _compress(chain[:, lane], data[lane, k].T, count[lane], np.where(ends, left[lane] - k * BLOCK, BLOCK), flags)
    return chain, many


def batches(sizes: Sequence[int]) -> Iterator[range]:
    """Ranges of neighbours whose whole chunks hold BATCH_BYTES at most, or one payload alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        size = max(1, -(-size // CHUNK)) * CHUNK
        if i > begin and held + size > BATCH_BYTES:
            yield range(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield range(begin, len(sizes))


def blake3(payloads: Sequence[bytes]) -> list[bytes]:
    """The 32-byte hash of each payload."""
    return [h for part in batches([len(p) for p in payloads]) for h in _together(payloads[part.start : part.stop])]


def _together(payloads: Sequence[bytes]) -> list[bytes]:
    chain, many = _chunks(payloads)
    # pairs of neighbours merge level by level, and an odd last node waits for the next level: the specification's tree
    while (many > 1).any():
        begin = np.cumsum(many) - many
        place = np.arange(many.sum()) - np.repeat(begin, many)
        total = np.repeat(many, many)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < total))
        flags = PARENT | np.where(total[left] == 2, ROOT, 0)
        zero = np.zeros(len(left), np.int64)
        chain[:, left] = _compress(np.repeat(INITIAL[:, None], len(left), axis=1), np.concatenate([chain[:, left], chain[:, left + 1]]), zero, zero + BLOCK, flags)
        chain, many = chain[:, place % 2 == 0], (many + 1) // 2
    return [c.astype("<u4").tobytes() for c in chain.T]


@F.pandas_udf(BinaryType())
def blake3_of(payload: pd.Series) -> pd.Series:
    """The hash of a binary column; null for null."""
    some = payload.notna()
    out = pd.Series([None] * len(payload), payload.index, dtype=object)
    out[some] = blake3([bytes(p) for p in payload[some]])
    return out
