"""URL verdicts: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Every url gives candidate keys: the suffixes of its host of as many labels as some listed host has, with each prefix of
its path that is as long as some listed path. The filter (blocks of 256 bits) lets possible hits through; an equi-join
with the list removes false positives, and only rows with possible hits are shuffled. The longest key wins, on equal lengths the smaller key. DataFrame functions only.

Null urls and urls without "://" have empty host and path; a url whose host is empty matches nothing. Repeated rows
each get a row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host and path, action)
Rules = Sequence[tuple[str, str]]
#: Blocks of the filter, 256 bits each, for a short list; a longer one has a block for so many keys.
BLOCKS, KEYS_A_BLOCK = 4096, 16
#: A list of more bytes than this is joined by shuffle, its keys repeated for each salt.
BROADCAST_BYTES = 4 << 20
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bits(key: Column) -> list[Column]:
    """Two bits in each of four 64-bit words."""
    h = F.xxhash64(F.lit(7), key)
    return [

        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 12 * i), F.lit(64)).cast("int")).bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 12 * i + 6), F.lit(64)).cast("int"))
        )
        for i in range(4)
    ]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row: word j of block b at b * 4 + j."""
    merged = keys.groupBy(_block(F.col("key"), blocks).alias("b")).agg(*(F.bit_or(w).alias(f"w{j}") for j, w in enumerate(_bits(F.col("key")))))
    words = F.map_from_entries(F.collect_list(F.struct("b", F.array("w0", "w1", "w2", "w3"))))
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    return merged.agg(words.alias("m")).select(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.try_element_at("m", b), zero))).alias("words")
    )


def judge(pages: DataFrame, rules: Rules, default: str = "allow", id_col: str = "page_id", url_col: str = "url", blocks: int | None = None) -> DataFrame:
    """Per row: id, host, path, rule (the winning key or null) and verdict (its action, else default)."""
    spark = pages.sparkSession
    listed_keys = dict(rules)
    listed = spark.createDataFrame(list(listed_keys.items()), "key string, action string")
    blocks = blocks or max(BLOCKS, 1 << (len(listed_keys) // KEYS_A_BLOCK).bit_length())
    lengths = sorted({len(k) - k.index("/") for k in listed_keys})
    labels = sorted({k[: k.index("/")].count(".") + 1 for k in listed_keys})
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    # as many labels as some rule has, so that a long host gives no more keys than a short one
    hosts = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in labels)))
    paths = F.array(*(F.substring(F.col("path"), 1, n) for n in lengths))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(F.array_distinct(paths), lambda p: F.concat(h, p))))
    rows = rows.withColumn("keys", F.when(F.col("host") != "", pairs).otherwise(F.array().cast("array<string>"))).withColumn("words", bloom(listed, blocks).scalar())

    def possible(key: Column) -> Column:
        b = _block(key, blocks) * 4
        tests = [F.get("words", b + j).bitwiseAND(w) == w for j, w in enumerate(_bits(key))]
        return tests[0] & tests[1] & tests[2] & tests[3]

    passed = rows.withColumn("hits", F.filter("keys", possible)).drop("keys", "words")
    none = passed.where(F.size("hits") == 0).select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = passed.where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "host", "path", F.explode("hits").alias("key"))
    if sum(map(len, listed_keys)) <= BROADCAST_BYTES:
        found = hits.join(F.broadcast(listed), "key", "left")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    # the longest, of these the smallest
    best = F.min(F.when(F.col("action").isNotNull(), F.struct((-F.length("key")).alias("n"), "key", "action")))
    ruled = found.groupBy("row", "id", "host", "path").agg(best.alias("best"))
    return none.unionByName(ruled.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")))
