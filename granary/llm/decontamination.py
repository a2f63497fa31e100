"""Benchmark decontamination: size-partitioned MinHash containment, then exact shingle containment. DataFrame functions only.

An item of n distinct shingles is indexed under its n - ceil(t * n) + 1 smallest shingle hashes: items of each size
have a sketch of their size's length, so a document that holds t of an item's shingles has one of its sketch's, however
long the document is, and no item is missed. Candidates are checked on the shingles themselves.

Words are lower-cased (A-Z) and split at blanks. Items of fewer words than a shingle are one shingle of their length.
Null, empty and blank texts and items match nothing. Repeated document rows with one id give one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BLANK_CLASS, written

#: Broadcast the sketch up to this many rows of 20 bytes.
MAX_SKETCH = 200_000


def words(text: Column) -> Column:
    lower = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), BLANK_CLASS, -1), lambda w: w != "")


def grams(w: Column, k: Column | int, hashed: bool) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)) if hashed else F.array_join(F.slice(w, i, k), " "))

    # the words are bound by a lambda, else they would be split anew for each shingle
    return F.array_distinct(F.flatten(F.transform(F.array(w), of)))


def contained(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of document and item: id, item id, item_shingles, shared."""
    test = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("iw")).where("size(iw) > 0").dropDuplicates(["item", "iw"])
    test = test.withColumn("k", F.least(F.size("iw"), F.lit(size))).withColumn("sh", grams(F.col("iw"), F.col("k"), False)).withColumn("n", F.size("sh"))
    test = written(test.select("item", "k", "sh", "n", F.array_sort(grams(F.col("iw"), F.col("k"), True)).alias("h")), "items")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    sketch = test.select("item", "k", F.explode(F.slice("h", 1, keep)).alias("h"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    probes = None
    for (k,) in sorted(test.select("k").distinct().collect()):
        p = rows.select("id", F.explode(grams(words(F.col("t")), k, True)).alias("h")).withColumn("k", F.lit(k))
        probes = p if probes is None else probes.unionByName(p)
    if probes is None:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast(items.schema[item_id].dataType).alias(item_id), F.lit(0).alias("item_shingles"), F.lit(0).alias("shared")).where("false")
    small = sketch.limit(MAX_SKETCH + 1).count() <= MAX_SKETCH
    pairs = written(probes.join(F.broadcast(sketch) if small else sketch, ["k", "h"]).select("id", "item").distinct(), "candidates")
    text = rows.join(pairs, "id").join(test.select("item", "k", "sh", "n"), "item")
    # per word length of a shingle: k is a column here
    both = text.withColumn("shared", F.size(F.array_intersect("sh", grams(words(F.col("t")), F.col("k"), False))))
    hit = both.where(F.col("shared") * 100 >= F.col("n") * percent)
    return hit.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_id)).agg(F.max("n").alias("item_shingles"), F.max("shared").alias("shared"))
