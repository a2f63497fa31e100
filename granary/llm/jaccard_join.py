"""N-gram Jaccard join by a blocked sparse product of documents and n-grams, exact at the threshold.

Rows of the matrix are the different shingle sets; equal texts, and then texts of equal sets, are one row. All columns are
counted exactly (blocks.shared), and a row's columns go rare first, ties by hash. By the size-derived bound, two rows that
reach the threshold share one of their first n - ceil(t * n) + 1 columns, so only those of these that another row holds
enter the product. A block of it is a column: it gives pairs, of which those go whose sizes, or what both can still
share from that column on, are below the bound. For the pairs left the product is computed whole: sets are cut
into blocks of columns by hash, the overlap of each block is counted, and the counts are added up over the blocks.

A column isn't expanded into all its pairs: its rows are paired with one of them, components found so far are
contracted, and this repeats. What then still meets in a column from different components is paired within classes of
size. So a group of near copies costs a star, and no link between two components is lost.

Null, empty and blank texts have no shingles and link with nothing. Repeated ids each keep their row and the
component of its text; a component is named by its smallest id that is not null, and by null where all its ids are.
Shingles are compared by 64-bit hashes, so a result is exact but for collisions of these.
Memory: a chunk of texts; two documents' shingles of one block of columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import blocks
from granary.llm.common import arrow_map, drop_written, give_back, mix, texts_of, written
from granary.operators.staging import release

SIZE, PERCENT = 5, 75
#: Rounds that link a column's rows with one row before the rest is paired.
STARS = 3
#: Blocks of columns, as bits of the hash.
BLOCK_BITS = 3
#: Ids that may be broadcast (8 bytes each); more are joined.
MAX_BROADCAST = 1_000_000

_ODD = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: A 64-bit number for each byte, letters A-Z as a-z, and whether a byte belongs to a word.
_BYTE = mix(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1))
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _ODD and of its inverse, from 0 to n."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_ODD, _BACK)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start, and their hashes (a polynomial of their bytes, lower-cased)."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _WORD[codes]
    turn = np.diff(inside.view(np.int8))
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _power(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of the whole sequence if it is shorter."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    start, h = word_hashes(b"\n".join(raws))
    edge = np.searchsorted(start, begins)

    def joined(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(x) - k + 1, k, np.uint64)
        for j in range(k):
            out += x[j : len(x) - k + 1 + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) + 2 * j) & 0xFFFFFFFFFFFFFFFF | 1)
        return mix(out)

    every = joined(h, size) if len(h) >= size else h[:0]
    out = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(blocks.unlike(np.sort(every[lo : hi - size + 1])))
        else:
            out.append(joined(h[lo:hi], hi - lo) if hi > lo else h[:0])
    return out


def _postings(texts: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """(col, no, n, pos) of the first columns of each text that another text holds too."""

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(blocks.unpacked(k) for k in right["keys"].to_pylist())])
        counts = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(c, np.int32) for c in right["counts"].to_pylist())])
        keys, at = np.unique(keys, return_index=True)
        counts, numbers = counts[at], left["no"].to_numpy()
        out = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.int32)]
        texts, row = left["text"], 0
        for lo in range(0, len(texts) if len(keys) else 0, 200):
            for s in shingle_sets(texts_of(texts.slice(lo, 200)), size):
                n, cut = len(s), blocks.cut(s)
                if n:
                    at = np.minimum(np.searchsorted(keys, cut), len(keys) - 1)
                    many = np.where(keys[at] == cut, counts[at], 1)
                    first = np.argsort(many, kind="stable")[: n - -(-percent * n // 100) + 1]
                    pos = np.flatnonzero(many[first] > 1)
                    for x, v in zip(out, (s[first[pos]].view(np.int64), np.full(len(pos), numbers[row]), np.full(len(pos), n), pos.astype(np.int32)), strict=True):
                        x.append(v)
                row += 1
        keys = counts = None
        give_back()
        return pa.table({k: np.concatenate(v) for k, v in zip(("col", "no", "n", "pos"), out, strict=True)})

    both = texts.select("chunk", "no", "text").groupBy("chunk").cogroup(found.groupBy("chunk"))
    return both.applyInArrow(chunk, "col bigint, no bigint, n bigint, pos int")


def _segments(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(no, block, part) of the texts whose number is wanted: their shingles by blocks of columns."""
    side = F.broadcast(wanted) if wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else wanted

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows, block, part = [], [], []
            for i, s in enumerate(shingle_sets(texts_of(b.column(1)), size)):
                edge = np.searchsorted(s, np.arange(1 << BLOCK_BITS, dtype=np.uint64) << np.uint64(64 - BLOCK_BITS)).tolist()
                for j, (lo, hi) in enumerate(zip(edge, [*edge[1:], len(s)], strict=True)):
                    if hi > lo:
                        rows.append(i)
                        block.append(j)
                        part.append(s[lo:hi].tobytes())
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(block, pa.int32()), pa.array(part, pa.binary())], names=["no", "block", "part"])

        return step

    return arrow_map(texts.join(side, "no", "left_semi").select("no", "text"), "no bigint, block int, part binary", make, 200)


def checked(pairs: DataFrame, texts: DataFrame, percent: int, size: int = SIZE) -> DataFrame:
    """Pairs (a, b, n, m) whose overlap, added up over the blocks of columns, reaches the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    parts = written(_segments(texts, wanted, size), "segments")
    one = pairs.join(parts.select(F.col("no").alias("a"), "block", F.col("part").alias("x")), "a")
    both = one.join(parts.select(F.col("no").alias("b"), "block", F.col("part").alias("y")), ["b", "block"])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            same = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                same.append(int((x[np.minimum(at, len(x) - 1)] == y).sum()))
            return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(same, pa.int64())], names=["a", "b", "n", "m", "same"])

        return step

    counts = arrow_map(both.select("a", "b", "n", "m", "x", "y"), "a bigint, b bigint, n bigint, m bigint, same bigint", make)
    total = counts.groupBy("a", "b", "n", "m").agg(F.sum("same").alias("same"))
    links = written(total.where(F.col("same") * 100 >= (F.col("n") + F.col("m") - F.col("same")) * percent).select("a", "b"), "links")
    drop_written(parts)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the ids in edges (a, b); root is the smallest id reachable. Alternates large and small stars."""
    at = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        nxt = written(small, "edges")
        if not nxt.exceptAll(at).limit(1).count() and not at.exceptAll(nxt).limit(1).count():
            return nxt.select(F.col("u").alias("id"), F.col("v").alias("root"))
        at = nxt


def links(post: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame | None:
    """(id, root) of the numbers that are linked with others, from the postings (col, no, n, pos)."""
    percents, n, m = F.lit(percent), F.col("n"), F.col("m")
    # sizes, and what can still be shared from this column on; every linked pair passes at its first common column
    rest = 1 + F.least(n - 1 - F.col("pos"), m - 1 - F.col("pos_b"))
    near = (n * 100 >= m * percents) & (m * 100 >= n * percents) & (rest * (100 + percents) >= (n + m) * percents)
    edges, roots, done = None, None, None
    for turn in range(STARS + 1):
        at = post.withColumn("root", F.col("no")) if roots is None else post.join(roots.withColumnRenamed("id", "no"), "no", "left").withColumn("root", F.coalesce("root", "no"))
        mixed = at.groupBy("col").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("col")
        at = at.join(mixed, "col")
        other = at.select("col", F.col("no").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos_b"), F.col("root").alias("root_b"))
        if turn < STARS:
            # one row of the column, another in each round
            pick = F.min(F.struct(F.xxhash64("no", F.lit(turn)).alias("h"), "no", "n", "pos", "root")) if turn else F.min(F.struct("pos", "no", "n", "root"))
            hub = at.groupBy("col").agg(pick.alias("x")).select("col", F.col("x.no").alias("no"), F.col("x.n").alias("n"), F.col("x.pos").alias("pos"), F.col("x.root").alias("root"))
            pairs = other.join(hub, "col").where(F.col("root") != F.col("root_b"))
        else:
            # sizes within the threshold are of the same class or of neighbours
            kind = lambda x: F.floor(F.log(F.col(x).cast("double")) / F.log(F.lit(max(100 / percent, 1.01))) + 1e-9)
            classed = at.withColumn("class", kind("n"))
            other = other.withColumn("class", F.explode(F.array(kind("m") - 1, kind("m"), kind("m") + 1)))
            pairs = classed.join(other, ["col", "class"]).where(F.col("root") < F.col("root_b"))
        first = F.col("no") < F.col("b")
        pairs = pairs.where(near).select(F.least("no", "b").alias("a"), F.greatest("no", "b").alias("b"), F.when(first, n).otherwise(m).alias("n"), F.when(first, m).otherwise(n).alias("m")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        done = pairs if done is None else done.union(pairs)
        good = checked(pairs, texts, percent, size)
        edges = good if edges is None else edges.union(good)
        if edges.limit(1).count():
            roots = components(edges)
    return roots


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id; with a column that numbers the rows, also that and whether the row is its component's first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    rows = written(df.select(F.col(id_col).alias("id"), number.alias("row"), F.md5(text).alias("digest")), "rows")

    def sized(texts: list[str]) -> list[pa.Array]:
        sets = [s for lo, hi in blocks.spans(texts) for s in shingle_sets(texts[lo:hi], size)]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())]

    texts = blocks.chunked(blocks.unique_texts(df, text), "texts", "n bigint, key binary, ", sized)
    release(df.sparkSession)
    found = written(blocks.shared(texts, lambda t: shingle_sets(t, size)), "shared")
    release(df.sparkSession)
    # one text of each set
    node = texts.where("n > 0").groupBy("key").agg(F.min("no").alias("node"))
    post = _postings(texts, found, size, percent).join(node.select(F.col("node").alias("no")), "no", "left_semi")
    post = written(post, "postings")
    drop_written(found)
    release(df.sparkSession)
    both = post.groupBy("col").agg(F.count("*").alias("c")).where("c > 1").select("col")
    once, post = post, written(post.join(both, "col"), "columns")
    drop_written(once)
    roots = links(post, texts, percent, size)
    # what names a component: its smallest id, null last
    small = texts.select("digest", "n", "key").where("n > 0").join(node, "key").select("digest", "n", "node")
    if roots is not None:
        small = small.join(roots.withColumnRenamed("id", "node"), "node", "left").select("digest", "n", F.coalesce("root", "node").alias("node"))
    small = written(small, "roots")
    drop_written(texts, post)
    release(df.sparkSession)
    of = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("x"))
    name = of.join(small, "digest").groupBy("node").agg(F.min("x").alias("x"))
    by_text = small.join(name, "node").select("digest", "n", F.col("x.id").alias("rep"), F.col("x.row").alias("first"))
    named = rows.join(by_text, "digest", "left")
    has = F.col("n").isNotNull()
    out = [F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.when(has, F.col("rep")).otherwise(F.col("id")).alias("component_id")]
    if row_col:
        out += [F.col("row").alias(row_col), F.when(has, F.col("row") == F.col("first")).otherwise(F.lit(True)).alias("first")]
    return named.select(*out)
