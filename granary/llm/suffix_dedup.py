"""Suffix-array dedup: bytes of earlier-seen strings are removed, the first document's copy stays.

Equal texts are one document (copies of LENGTH bytes or more but the first are removed whole). Every string of
LENGTH bytes holds an anchor, a K-byte string whose hash is the smallest of LENGTH - K + 1 neighbours, so documents
that share such a string share its anchor at the same place. Anchors of one document only are dropped before anything is
shuffled (blocks.shared); of the others, a chunk sends each different surrounding once.

What surrounds the anchors of a block is put in suffix order, to the right from the anchor and to the left of it, with the
common prefixes of neighbours (LCP). Strings with a common prefix of LENGTH bytes are a run in that order, and the
longest previous factor of a place reaches LENGTH when a smaller place stands before or after it in its run: the smallest
place of the run decides both. All others of the run are removed.

An anchor of more than HOT documents could make one task too large: its strings of LENGTH bytes are
aggregated by value, with partial sums before the shuffle. Both ways compare bytes, and give the same result.

Null and empty texts have no bytes. The order of texts is that of their ids, null ids last, then of a digest of the text.
Rows of one id with one text are one document; different texts under one id are different documents, and so is each
row with a null id, so of equal texts under null ids alone one stays.
Memory: a chunk of texts, a block of surroundings, one text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import blocks
from granary.llm.common import arrow_map, drop_written, mix, texts_of, written
from granary.operators.staging import release

LENGTH, K = 50, 16
REACH = LENGTH - K
#: Documents of an anchor beyond which it is not gathered, and surroundings of a block.
HOT, BLOCK = 30_000, 20_000


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each width neighbours, by doubling."""
    have = 1
    out = x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of some bytes."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = raw.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < k:
        m = np.uint64((0x9E3779B97F4A7C15 * (2 * width + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = h[:-width] * m + h[width:]
        width *= 2
    h = mix(h)
    span = length - k + 1
    low = _slide(h, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), span, np.maximum)
    at = np.flatnonzero(h == high[: len(h)])
    # the smallest of many hashes are small; mixed again they fill all ranges alike
    return at, mix(h[at])


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes with LENGTH zeros around each, and where each begins and ends. Strings across texts add anchors, but hide none."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = bytes(LENGTH)
    raw = np.frombuffer(gap + gap.join(raws) + gap, np.uint8)
    size = np.array([len(r) for r in raws], np.int64)
    begin = np.cumsum(size + LENGTH) - size
    return raw, begin, begin + size


def _places(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in raw, hash) of the anchors inside texts."""
    at, h = anchors(raw)
    text = np.searchsorted(begin, at, "right") - 1
    inside = (text >= 0) & (at + K <= end[text])
    return text[inside], at[inside], h[inside]


def anchor_hashes(texts: list[str]) -> list[np.ndarray]:
    text, _, h = _places(*_laid_out(texts))
    return [np.unique(x) for x in np.split(h, np.searchsorted(text, np.arange(1, len(texts))))]


#: Blobs of the surroundings in a range of anchors; else one surrounding of a frequent anchor, or a blob of the ranges that a chunk's texts lose.
_AROUND = "part bigint, chunk bigint, blob binary, no bigint, rank bigint, lo bigint, hi bigint, before int, around binary"
_NAMES = [c.split()[0] for c in _AROUND.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
#: Ranges that texts lose: blobs by chunk, or single ones.
_LOST = "chunk bigint, blob binary, no bigint, lo bigint, hi bigint"

#: hash, chunk, no, rank, lo, before, after and the bytes around of some anchors.
Rows = tuple[np.ndarray, ...]


def _to_blob(rows: Rows) -> bytes:
    """Compressed, byte planes first: what is constant or small in a column costs nothing."""
    planes = [np.ascontiguousarray(c.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in rows if c.ndim == 1]
    return zstandard.ZstdCompressor(level=9).compress(b"".join([*planes, *(c.tobytes() for c in rows if c.ndim > 1)]))


def _from_blob(blob: bytes, numbers: int, width: int = 0) -> Rows:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (8 * numbers + width)
    columns = [np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view(np.int64).ravel() for i in range(numbers)]
    return (*columns, raw[8 * numbers * n :].reshape(n, width)) if width else tuple(columns)


def _merged(no: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document that touch or overlap as one."""
    if not len(no):
        return no, lo, hi
    order = np.lexsort((lo, no))
    no, lo, hi = no[order], lo[order], hi[order]
    doc = np.cumsum(np.diff(no, prepend=no[0]) != 0)
    wide = int(hi.max()) + 1
    end = np.maximum.accumulate(hi + doc * wide)
    start = np.flatnonzero(np.concatenate([[True], (lo + doc * wide)[1:] > end[:-1]]))
    return no[start], lo[start], np.maximum.reduceat(hi, start)


def _alike(around: np.ndarray, before: np.ndarray, after: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by surroundings and then rank, and the number of each one's kind in that order."""
    as_text = np.ascontiguousarray(around).view(f"S{around.shape[1]}").ravel()
    order = np.lexsort((rank, after, before, as_text))
    new = np.ones(len(order), bool)
    for x in (as_text, before, after):
        new[1:] &= x[order][1:] == x[order][:-1]
    new[1:] = ~new[1:]
    return order, np.cumsum(new) - 1


def _surroundings(texts: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """What is around the shared anchors of each chunk, each kind from its first document, and the ranges the others lose."""
    hot = HOT

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(blocks.unpacked(k) for k in right["keys"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(c, np.int32) for c in right["counts"].to_pylist())])
        keys, at = np.unique(keys, return_index=True)
        counts = counts[at]
        texts, nos, ranks = texts_of(left["text"]), left["no"].to_numpy(), left["rank"].to_numpy()
        number = left["chunk"][0].as_py() if len(texts) else 0
        held = []
        for lo, hi in blocks.spans(texts) if len(keys) else ():
            raw, begin, end = _laid_out(texts[lo:hi])
            text, at, h = _places(raw, begin, end)
            key = np.minimum(np.searchsorted(keys, blocks.cut(h)), len(keys) - 1)
            hit = keys[key] == blocks.cut(h)
            text, at, h, key = text[hit], at[hit], h[hit], key[hit]
            before, after = np.minimum(at - begin[text], REACH), np.minimum(end[text] - at, LENGTH)
            held.append((h, np.full(len(h), number), nos[lo:hi][text], ranks[lo:hi][text], at - begin[text] - before, before, after, raw[at[:, None] + np.arange(-REACH, LENGTH)], counts[key] > hot))
        out = []
        if sum(len(x[0]) for x in held):
            *rows, many = (np.concatenate(x) for x in zip(*held, strict=True))
            no, rank, lo, before, after, around = rows[2:]
            order, kind = _alike(around, before, after, rank)
            mine = rank[order] == rank[order][np.flatnonzero(np.diff(kind, prepend=-1))][kind]
            gone, one = order[~mine], order[mine]
            if len(gone):
                out.append({"chunk": number, "blob": _to_blob(_merged(no[gone], lo[gone], (lo + before + after)[gone]))})
            out += [{"chunk": number, "no": int(no[i]), "rank": int(rank[i]), "lo": int(lo[i]), "hi": int(lo[i] + before[i] + after[i]), "before": int(before[i]), "around": around[i].tobytes()} for i in one[many[one]].tolist()]
            one = one[~many[one]]
            one = one[np.argsort(rows[0][one])]
            part = (blocks.cut(rows[0][one]).astype(np.float64) * (parts / 2.0**blocks.BITS)).astype(np.int64)
            edge = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(one)]
            out += [{"part": int(part[i]), "blob": _to_blob(tuple(c[one[i:j]] for c in rows))} for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_pylist(out, pa.schema(list(zip(_NAMES, _TYPES, strict=True))))

    both = texts.select("chunk", "no", "rank", "text").groupBy("chunk").cogroup(found.groupBy("chunk"))
    return both.applyInArrow(chunk, _AROUND)


def _classes(part: np.ndarray) -> list[np.ndarray]:
    """For each length up to the width: the number of each row's class of equal prefixes, by suffix order and LCP."""
    width = part.shape[1]
    wide = np.zeros((len(part), -(-width // 8) * 8), np.uint8)
    wide[:, :width] = part
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(words[:, j] for j in range(words.shape[1] - 1, -1, -1)))
    ahead = wide[order]
    lcp = np.argmax(np.concatenate([ahead[1:] != ahead[:-1], np.ones((len(part) - 1, 1), bool)], axis=1), axis=1) if len(part) > 1 else np.zeros(0, np.int64)
    out = []
    for length in range(width + 1):
        c = np.empty(len(part), np.int64)
        c[order] = np.concatenate([[0], np.cumsum(lcp < length)])
        out.append(c)
    return out


def _later(around: np.ndarray, before: np.ndarray, after: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per surrounding and start in it: has its string of LENGTH bytes a smaller place in its run? Rows must come by rank."""
    out = np.zeros((len(around), REACH + 1), bool)
    # classes of bytes to the left, from the anchor outwards, and to the right
    lefts, rights = _classes(np.ascontiguousarray(around[:, REACH - 1 :: -1])), _classes(np.ascontiguousarray(around[:, REACH:]))
    for start in range(REACH + 1):
        back, ahead = REACH - start, LENGTH - REACH + start
        rows = np.flatnonzero((before >= back) & (after >= ahead))
        if len(rows) < 2:
            continue
        string = lefts[back][rows] * len(around) + rights[ahead][rows]
        order = np.argsort(string, kind="stable")
        new = np.concatenate([[True], np.diff(string[order]) != 0])
        least = rank[rows][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        out[rows[order], start] = rank[rows][order] > least
    return out


def _ranges(rows: Rows) -> Rows:
    """(chunk, no, lo, hi) of what the documents of a block of whole anchors lose."""
    h, chunk, no, rank, lo, before, after, around = rows
    order, kind = _alike(around, before, after, rank)
    head = order[np.flatnonzero(np.diff(kind, prepend=-1))]
    # equal surroundings: all but the first document's are covered whole, and one of each is put in order
    whole = order[rank[order] > rank[head][kind]]
    first, first_kind = order[rank[order] == rank[head][kind]], kind[rank[order] == rank[head][kind]]
    _, group, size = np.unique(h[head], return_inverse=True, return_counts=True)
    some = np.flatnonzero(size[group] > 1)
    some = some[np.argsort(rank[head[some]], kind="stable")]
    found = np.zeros((len(head), REACH + 1), bool)
    found[some] = _later(around[head[some]], before[head[some]], after[head[some]], rank[head[some]])
    # strings that start less than LENGTH apart cover what is between them
    hit = found[first_kind].any(1)
    first, found = first[hit], found[first_kind[hit]]
    base = lo[first] + before[first] - REACH
    low, high = base + found.argmax(1), base + REACH - found[:, ::-1].argmax(1) + LENGTH
    return tuple(np.concatenate(x) for x in ((chunk[whole], chunk[first]), (no[whole], no[first]), (lo[whole], low), ((lo + before + after)[whole], high)))


def _gathered(around: DataFrame) -> DataFrame:
    """Lost ranges by blocks of whole anchors, a blob for each chunk."""

    def part(table: pa.Table) -> pa.Table:
        rows = tuple(np.concatenate(c) for c in zip(*(_from_blob(x, 7, REACH + LENGTH) for x in table["blob"].to_pylist()), strict=True))
        order = np.argsort(rows[0], kind="stable")
        new = np.flatnonzero(np.diff(rows[0][order], prepend=rows[0][order][:1] - 1))
        # the first anchor of each block
        cut = new[np.flatnonzero(np.diff(new // BLOCK, prepend=-1))].tolist()
        found = [_ranges(tuple(c[order[i:j]] for c in rows)) for i, j in zip(cut, [*cut[1:], len(order)], strict=True)]
        chunk, *lost = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(chunk, kind="stable")
        edge = [*np.flatnonzero(np.diff(chunk[order], prepend=-1)).tolist(), len(order)]
        out = [{"chunk": int(chunk[order[i]]), "blob": _to_blob(_merged(*(c[order[i:j]] for c in lost)))} for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("blob", pa.binary()), *((c, pa.int64()) for c in ("no", "lo", "hi"))]))

    return around.groupBy("part").applyInArrow(part, _LOST)


def _aggregated(around: DataFrame) -> DataFrame:
    """The same for anchors of many documents: each string by value, its first document found by aggregation."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows, lo, val = [], [], []
            for i, (a, end, left, c) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3, 7)), strict=True)):
                for s in range(REACH - left, REACH - left + end - a - LENGTH + 1):
                    rows.append(i)
                    lo.append(a + left - REACH + s)
                    val.append(c[s : s + LENGTH])
            where = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*(b.column(j).take(where) for j in range(3)), pa.array(lo, pa.int64()), pa.array(val, pa.binary())], names=["chunk", "no", "rank", "lo", "val"])

        return step

    kind = ["before", F.col("hi") - F.col("lo"), "around"]
    first = F.min("rank").over(Window.partitionBy(*kind))
    around = written(around.withColumn("first", first), "frequent")
    none = F.lit(None).cast("binary").alias("blob")
    copies = around.where("rank > first").select("chunk", none, "no", "lo", "hi")
    each = written(arrow_map(around.where("rank = first").select("chunk", "no", "rank", "lo", "hi", "before", "around"), "chunk bigint, no bigint, rank bigint, lo bigint, val binary", make, 1000).distinct(), "strings")
    least = each.groupBy("val").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first != last").select("val", "first")
    return copies.union(each.join(least, "val").where("rank > first").select("chunk", none, "no", "lo", (F.col("lo") + LENGTH).alias("hi")))


def _remaining(texts: DataFrame, lost: DataFrame, keep: bool) -> DataFrame:
    """(digest, kept, n_removed, n_spans, kept_sha256) of the texts of each chunk and the ranges they lose."""

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = [_from_blob(b, 3) for b in right["blob"].to_pylist() if b is not None]
        single = right.filter(pc.is_null(right["blob"]))
        every = [*blobs, tuple(single[c].to_numpy() for c in ("no", "lo", "hi"))]
        no, lo, hi = _merged(*(np.concatenate(c) for c in zip(*every, strict=True)))
        out = []
        for n, digest, text in zip(left["no"].to_pylist(), left["digest"].to_pylist(), left["text"], strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            some = range(*np.searchsorted(no, [n, n + 1]).tolist())
            ends = [0, *(x for i in some for x in (int(lo[i]), int(hi[i]))), len(raw)]
            kept = b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True))
            out.append((digest, kept if keep else None, len(raw) - len(kept), len(some), hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema(list(zip(names, kinds, strict=True))))

    names = ["digest", "kept", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    both = texts.select("chunk", "no", "digest", "text").groupBy("chunk").cogroup(lost.groupBy("chunk"))
    return both.applyInArrow(chunk, "digest string, kept binary, n_removed bigint, n_spans bigint, kept_sha256 string")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: id, kept (the remaining bytes; null unless asked for), n_bytes, n_removed, n_spans and kept_sha256."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long")
    ids = df.select(F.col(id_col).alias("id"), size.alias("n_bytes"), F.md5(text).alias("digest"), F.when(size < LENGTH, text).alias("short"), F.monotonically_increasing_id().alias("row"))
    # what names a document and is never null: the id as a string, or the number of a row without id
    named = {"row": F.when(F.col("id").isNull(), F.col("row")).otherwise(F.lit(-1)), "name": F.coalesce(F.col("id").cast("string"), F.lit(""))}
    rows = written(ids.withColumns(named), "rows")
    long = rows.where(F.col("n_bytes") >= LENGTH)
    least = long.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "name")).alias("x")).select("digest", "x.*")
    firsts = written(least.orderBy("none", "id", "row", "digest").select("digest", "name", "row", F.monotonically_increasing_id().alias("rank")), "firsts")
    texts = blocks.chunked(blocks.unique_texts(df.where(size >= LENGTH), text).join(firsts.select("digest", "rank"), "digest"), "texts")
    release(spark)
    found = written(blocks.shared(texts, anchor_hashes), "shared")
    release(spark)
    around = written(_surroundings(texts, found, blocks.ranges(texts)), "surroundings")
    drop_written(found)
    release(spark)
    spans = _gathered(around.where("part is not null").select("part", "blob"))
    frequent = around.where("around is not null")
    if frequent.limit(1).count():
        spans = spans.union(_aggregated(frequent.select("chunk", "no", "rank", "lo", "hi", "before", "around")))
    others = around.where("part is null and around is null").select("chunk", "blob", "no", "lo", "hi")
    lost = written(spans.union(others), "lost")
    drop_written(around)
    release(spark)
    made = written(_remaining(texts, lost, keep), "remaining")
    drop_written(texts, lost)
    release(spark)
    out = [F.col("id").alias(id_col), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same = ["name", "row", "digest"]
    own = long.join(firsts, same).join(made, "digest").select(out)
    gone = F.encode(F.lit(""), "UTF-8")
    kept = lambda x: x if keep else F.lit(None).cast("binary")
    copies = long.join(firsts, same, "left_anti").withColumns({"kept": kept(gone), "n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(gone, 256)}).select(out)
    short = rows.where(F.col("n_bytes") < LENGTH).withColumns({"kept": kept(F.encode("short", "UTF-8")), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2(F.encode("short", "UTF-8"), 256)}).select(out)
    return own.unionByName(copies).unionByName(short)
