"""Byte patches: copies out of a base and inserted bytes, with hashes of both sides, written and applied.

Blocks of the base are looked up at each byte of the target up to the next copy by a rolling sum, and only a block that a sum
finds is compared, so the time is linear in both but for chance hits. What a copy covers isn't searched. Base and target are one value each and must fit in a task.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from granary.functions.digests import batches, blake3

# fixed values of the patch format: magic, version, operations, block, shortest copy, limits
MAGIC, VERSION = b"IFDIFF01", 1
COPY, INSERT = 0, 1
SLICE, SHORTEST = 4096, 32
MAX_OPS, MAX_INSERTED, MAX_PATCH = 1_000_000, 256_000_000, 512_000_000

_HEAD = struct.Struct("<8sI32s32s")
#: Places of a target that are summed in one go, at most.
WINDOW = 1 << 16
_ODD = 0x9E3779B97F4A7C15
# powers of the sums' factor and of its inverse
_UP, _DOWN = (np.multiply.accumulate(np.array([1] + [f] * (WINDOW + SLICE), np.uint64)) for f in (_ODD, pow(_ODD, -1, 1 << 64)))


def _sums(data: bytes) -> np.ndarray:
    """A 64-bit sum of the SLICE bytes from each place on, the same wherever they stand."""
    codes = np.frombuffer(data, np.uint8) + np.uint64(1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _UP[: len(codes)], out=total[1:])
    return (total[SLICE:] - total[:-SLICE]) * _DOWN[: len(codes) - SLICE + 1]


class _Blocks:
    """The first place of each block of SLICE bytes of a base, and where such a block comes next in a target."""

    def __init__(self, base: bytes) -> None:
        self.places: dict[bytes, int] = {}
        for at in range(0, len(base) - SLICE + 1, SLICE):
            self.places.setdefault(base[at : at + SLICE], at)
        self.keys: np.ndarray | None = None

    def next(self, target: bytes, at: int) -> tuple[int, int]:
        """(place in the target from at on, place in the base); the target's end and 0 if there is none."""
        if not self.places or at + SLICE > len(target):
            return len(target), 0
        if (start := self.places.get(target[at : at + SLICE])) is not None:
            return at, start
        if self.keys is None:
            self.keys = np.unique(np.array([_sums(b)[0] for b in self.places], np.uint64))
        size = SLICE
        while at + SLICE <= len(target):
            sums = _sums(target[at : at + size + SLICE - 1])
            k = np.minimum(np.searchsorted(self.keys, sums), len(self.keys) - 1)
            for place in (np.flatnonzero(self.keys[k] == sums) + at).tolist():
                if (start := self.places.get(target[place : place + SLICE])) is not None:
                    return place, start
            at, size = at + len(sums), min(2 * size, WINDOW)
        return len(target), 0


def _shared(base: bytes, start: int, target: bytes, at: int) -> int:
    """How far base and target go on alike."""
    n, size, most = 0, SLICE, min(len(base) - start, len(target) - at)
    while n < most:
        left, right = base[start + n : start + min(n + size, most)], target[at + n : at + min(n + size, most)]
        if left != right:
            return n + int(np.flatnonzero(np.frombuffer(left, np.uint8) != np.frombuffer(right, np.uint8))[0])
        n, size = n + len(left), 2 * size
    return most


def _operations(base: bytes, target: bytes) -> bytes:
    """The operations that turn base into target."""
    blocks, out, at = _Blocks(base), [], 0
    # the base's short last block is met only by the target's last bytes
    rest = len(base) % SLICE
    tail = len(target) - rest if rest >= SHORTEST and target.endswith(base[-rest:]) else -1
    while at < len(target):
        begin, start = blocks.next(target, at)
        if at <= tail < begin:
            begin, start = tail, len(base) - rest
        if begin > at:
            out.append(struct.pack("<BI", INSERT, begin - at) + target[at:begin])
        if begin < len(target):
            n = _shared(base, start, target, begin)
            out.append(struct.pack("<BQI", COPY, start, n))
            begin += n
        at = begin
    return b"".join(out)


def created(pairs: Sequence[tuple[bytes, bytes]]) -> list[bytes]:
    """The patch of each (base, target); many are hashed at once, as a payload alone takes nearly as long as a batch of them."""
    hashes = blake3([side for pair in pairs for side in pair])
    return [_HEAD.pack(MAGIC, VERSION, *hashes[2 * i : 2 * i + 2]) + _operations(*pair) for i, pair in enumerate(pairs)]


def create(base: bytes, target: bytes) -> bytes:
    """The patch that turns base into target."""
    return created([(base, target)])[0]


def _head_fault(patch: bytes) -> str | None:
    """The first fault of a patch's size and head, hashes aside."""
    if len(patch) > MAX_PATCH:
        return "DiffLimitsExceeded"
    if len(patch) < _HEAD.size:
        return "DiffMalformed"
    magic, version, _, _ = _HEAD.unpack_from(patch)
    if magic != MAGIC:
        return "DiffMagicMismatch"
    return None if version == VERSION else "DiffVersionUnsupported"


def _executed(base: bytes, patch: bytes) -> tuple[str, bytes | None]:
    """(code, target) of a patch's operations, hashes aside."""
    out, at, ops, inserted = [], _HEAD.size, 0, 0
    while at < len(patch):
        kind, ops = patch[at], ops + 1
        at += 1
        if ops > MAX_OPS:
            return "DiffLimitsExceeded", None
        head = {COPY: 12, INSERT: 4}.get(kind)
        if head is None or at + head > len(patch):
            return "DiffMalformed", None
        n = struct.unpack_from("<I", patch, at + head - 4)[0]
        if kind == COPY:
            start = struct.unpack_from("<Q", patch, at)[0]
            if start + n > len(base):
                return "DiffEntryOutOfRange", None
            out.append(base[start : start + n])
            at += head
            continue
        inserted += n
        if inserted > MAX_INSERTED:
            return "DiffLimitsExceeded", None
        if at + head + n > len(patch):
            return "DiffMalformed", None
        out.append(patch[at + head : at + head + n])
        at += head + n
    return "Ok", b"".join(out)


def applied(pairs: Sequence[tuple[bytes, bytes]]) -> list[tuple[str, bytes | None]]:
    """(code, target) of each (base, patch): Ok and the bytes, or the first fault and null. Many are hashed at once."""
    out: list[tuple[str, bytes | None]] = []
    for part in batches([len(base) + len(patch) for base, patch in pairs]):
        now = pairs[part.start : part.stop]
        done = [(_head_fault(patch), None) for _, patch in now]
        heads = {i: _HEAD.unpack_from(now[i][1]) for i, (code, _) in enumerate(done) if code is None}
        for (i, head), before in zip(heads.items(), blake3([now[i][0] for i in heads]), strict=True):
            done[i] = _executed(*now[i]) if before == head[2] else ("DiffBaseHashMismatch", None)
        ends = [i for i in heads if done[i][0] == "Ok"]
        for i, after in zip(ends, blake3([done[i][1] for i in ends]), strict=True):
            if after != heads[i][3]:
                done[i] = "DiffTargetHashMismatch", None
        out += done
    return out


def apply(base: bytes, patch: bytes) -> tuple[str, bytes | None]:
    """(code, target): Ok and the bytes, or the first fault and null."""
    return applied([(base, patch)])[0]


def _pairs(left: pd.Series, right: pd.Series) -> list[tuple[bytes, bytes]]:
    return [(bytes(x or b""), bytes(y or b"")) for x, y in zip(left, right, strict=True)]


@F.pandas_udf(BinaryType())
def patch_of(base: pd.Series, target: pd.Series) -> pd.Series:
    """The patch between two binary columns; null counts as no bytes."""
    return pd.Series(created(_pairs(base, target)), dtype=object)


@F.pandas_udf(StructType().add("code", StringType()).add("content", BinaryType()))
def patched(base: pd.Series, patch: pd.Series) -> pd.DataFrame:
    """Code and content of a patch applied to a base; null counts as no bytes."""
    return pd.DataFrame(applied(_pairs(base, patch)), columns=["code", "content"])


def damaged(patch: Column, at: Column | int, byte: Column | int) -> Column:
    """A patch with one byte, counted from 1, put in place of another."""
    return F.overlay(patch, F.unhex(F.lpad(F.hex(F.lit(byte)), 2, F.lit("0"))), F.lit(at))
