"""Unique texts in chunks, and the keys that more than one of them holds, with exact counts.

Texts are numbered and dealt into chunks of about CHUNK bytes. Of its texts' keys (64-bit hashes, cut to BITS bits) a
chunk sends each once to the range of keys that owns it, packed as sorted differences, with the count of its texts that
hold it. A range adds the counts up and sends back those keys that more than one text holds. So what is shuffled is
about four bytes a key, no key is more frequent than there are chunks, and nothing is broadcast. A cut key may stand for
two keys; callers compare what it stands for.
Memory: one chunk of texts, or one range of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import give_back, texts_of, written

#: Bytes of text in a chunk, and bytes of text whose keys make a range.
CHUNK, RANGE = 3_000_000, 16_000_000
#: Bytes of text whose keys are computed at a time.
GROUP = 1_000_000
BITS = 48

#: Keys of some texts: a list of sorted distinct hashes for each.
Keys = Callable[[list[str]], list[np.ndarray]]


_SENT = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def unique_texts(df: DataFrame, text: str, *also: str) -> DataFrame:
    """One row (digest, *also, text) for each different text, copies being collapsed before the shuffle."""
    return df.groupBy(F.md5(text).alias("digest"), *also).agg(F.first(text).alias("text"))


def spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def chunked(df: DataFrame, name: str, extra: str = "", more: Callable[[list[str]], list[pa.Array]] | None = None) -> DataFrame:
    """df with no, a number for each row, and its chunk; and the columns that more gives for its texts. Staged."""
    at = df.columns.index("text")
    schema = "no bigint, chunk bigint, " + extra + "".join(f"{c} {t}, " for c, t in df.drop("text").dtypes) + "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = no = TaskContext.get().partitionId() << 33
        held = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                text = b.column(at)
                size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                before = held + np.concatenate([[0], size[:-1]])
                cols = [pa.array(np.arange(no, no + b.num_rows)), pa.array(first + before // CHUNK)]
                cols += more(text.to_pylist()) if more else []
                cols += [c for i, c in enumerate(b.columns) if i != at] + [text]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                no, held = no + b.num_rows, held + int(size[-1])
        whole = b = cols = text = None
        give_back()

    names = [c.split(" ")[0] for c in schema.split(", ")]
    return written(df.mapInArrow(run, schema), name)


def cut(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - BITS)


def unlike(keys: np.ndarray) -> np.ndarray:
    """Sorted keys without repeats."""
    return keys[np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0] if len(keys) else keys


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, their lowest bytes first: the highest are zeros, which compress to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def ranges(texts: DataFrame) -> int:
    """How many ranges the keys of these texts are dealt into."""
    return 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE


def shared(texts: DataFrame, keys: Keys) -> DataFrame:
    """(chunk, keys, counts) of the keys of (chunk, text) that more than one text holds, packed."""
    parts = ranges(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            mine, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            part = (mine.astype(np.float64) * (parts / 2.0**BITS)).astype(np.int64)
            at = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(mine)]
            out = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                many = np.flatnonzero(counts[lo:hi] > 1)
                out.append((int(part[lo]), chunk, packed(mine[lo:hi]), np.stack([many, counts[lo:hi][many]]).astype(np.int32).tobytes()))
            return pa.RecordBatch.from_pylist([dict(zip(("part", "chunk", "keys", "many"), x, strict=True)) for x in out], _SENT)

        held, chunk = [], None
        for b in batches:
            chunks = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and chunks[lo] != chunk:
                    yield done()
                    held = []
                chunk, some = int(chunks[lo]), texts_of(b.column(1).slice(lo, hi - lo))
                for i, j in spans(some):
                    held += [unlike(cut(k)) for k in keys(some[i:j])]
        if held:
            yield done()
        held, b, some = [], None, None
        give_back()

    def add(table: pa.Table) -> pa.Table:
        ks = [unpacked(k) for k in table["keys"].to_pylist()]
        counts = []
        for k, m in zip(ks, table["many"].to_pylist(), strict=True):
            n = np.ones(len(k), np.int64)
            at, more = np.frombuffer(m, np.int32).reshape(2, -1)
            n[at] = more
            counts.append(n)
        every = np.concatenate(ks)
        order = np.argsort(every, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) > 0]))
        total = np.add.reduceat(np.concatenate(counts)[order], start)
        many, total = every[order][start][total > 1], total[total > 1]
        out = []
        for k, c in zip(ks, table["chunk"].to_pylist(), strict=True):
            at = np.searchsorted(many, k)
            hit = at < len(many)
            hit[hit] = many[at[hit]] == k[hit]
            out.append({"chunk": c, "keys": packed(k[hit]), "counts": np.minimum(total[at[hit]], 2**31 - 1).astype(np.int32).tobytes()})
        every = order = ks = counts = None
        give_back()
        return pa.Table.from_pylist(out, _BACK)

    sent = texts.select("chunk", "text").mapInArrow(send, "part bigint, chunk bigint, keys binary, many binary")
    return sent.groupBy("part").applyInArrow(add, "chunk bigint, keys binary, counts binary")
