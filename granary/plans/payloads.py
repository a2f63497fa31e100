"""Queries on hashed, compressed and patched payloads and on their faults, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import categories, codecs
from granary.functions.digests import blake3_of
from granary.operators import patches
from granary.plans import formats


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and content: the bytes of each text, none for null."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _is(what: Column, *cases: Column) -> Column:
    """The case of a number counted from 0; of another number, the last."""
    out = cases[-1]
    for k, case in enumerate(cases[:-1]):
        out = F.when(what == k, case).otherwise(out)
    return out


def payload_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE3 of every text."""
    return _texts(spark, sf_dir).select("doc_id", F.lower(F.hex(blake3_of("content"))).alias("blake3"))


def deflate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text wrapped with deflate and read again."""
    return _texts(spark, sf_dir).select("doc_id", F.sha2(codecs.restored(codecs.wrapped("content")), 256).alias("sha256"))


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text packed into an archive and read again."""
    return _texts(spark, sf_dir).select("doc_id", F.sha2(codecs.unpacked(codecs.packed("content")), 256).alias("sha256"))


def archive_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of another version, of another kind, and cut short can't be read."""
    rows = _texts(spark, sf_dir).withColumn("whole", codecs.packed(F.concat("content", F.lit(b"0123456789"))))
    put = lambda at, byte: F.overlay("whole", F.unhex(F.lit(byte)), F.lit(at))
    case = _is(F.pmod("doc_id", F.lit(4)), F.col("whole"), put(1, "02"), put(2, "07"), F.substring("whole", F.lit(1), F.octet_length("whole") - 1))
    return rows.select("doc_id", codecs.unpacked(case).isNotNull().alias("readable"))


#: Ways in which a target differs from its base: bytes put in front, put behind, in both places, and none.
CHANGES = ("front", "back", "both", "same")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base, change, target."""
    rows = _texts(spark, sf_dir).withColumnRenamed("content", "base")
    front, back, kind = F.lit(b"header "), F.lit(b" trailer"), F.pmod("doc_id", F.lit(len(CHANGES)))
    target = _is(kind, F.concat(front, "base"), F.concat("base", back), F.concat(front, "base", back), F.col("base"))
    return rows.select("doc_id", "base", _is(kind, *map(F.lit, CHANGES)).alias("change"), target.alias("target"))


def byte_patch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch from every text to a changed one, applied."""
    rows = _changed(spark, sf_dir).withColumn("patch", patches.patch_of("base", "target"))
    return rows.select("doc_id", "change", patches.patched("base", "patch").alias("x")).select("doc_id", "change", "x.code", F.sha2("x.content", 256).alias("sha256"))


#: What becomes of a patch, and the code that this gives.
FAULTS = ("Ok", "DiffMagicMismatch", "DiffVersionUnsupported", "DiffBaseHashMismatch", "DiffTargetHashMismatch", "DiffMalformed", "DiffMalformed", "DiffEntryOutOfRange")


def patch_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged patches: the first fault of each."""
    rows = _texts(spark, sf_dir).withColumn("patch", patches.patch_of("content", F.concat("content", F.lit(b"!"))))
    head = F.substring("patch", 1, 76)
    cases = (
        F.col("patch"), patches.damaged(F.col("patch"), 1, 0), patches.damaged(F.col("patch"), 9, 2), F.concat(F.substring("patch", 1, 12), F.unhex(F.lit("00" * 32)), F.substring("patch", 45, 1 << 30)),
        F.concat(F.substring("patch", 1, 44), F.unhex(F.lit("00" * 32)), F.substring("patch", 77, 1 << 30)), F.substring("patch", 1, 75), patches.damaged(F.col("patch"), 77, 7),
        F.concat(head, F.unhex(F.lit("00" + "FFFFFFFFFFFFFF7F" + "01000000"))),
    )
    bad = _is(F.pmod("doc_id", F.lit(len(FAULTS))), *cases)
    return rows.select("doc_id", patches.patched("content", bad).alias("x")).select("doc_id", "x.code")


def patch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind of change: texts, bytes of the targets, and bytes of their patches."""
    rows = _changed(spark, sf_dir).select("change", F.octet_length("target").cast("long").alias("size"), F.octet_length(patches.patch_of("base", "target")).cast("long").alias("patch"))
    return rows.groupBy("change").agg(F.count("*").alias("n"), F.sum("size").alias("target_bytes"), F.sum("patch").alias("patch_bytes"), F.max("patch").alias("largest"))


def fault_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and common number of the first fault of each package."""
    rows = formats.package_faults(spark, sf_dir)
    return rows.withColumn("x", categories.category_of("package", F.col("code"))).select("path", "x.category", "x.number")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (payload_blake3, deflate_round_trip, archive_round_trip, archive_refusals, byte_patch_round_trip, patch_faults, patch_sizes, fault_categories)
}

_SAME = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents"
SQL: dict[str, str] = {
    "deflate_round_trip": _SAME,
    "archive_round_trip": _SAME,
    "archive_refusals": "SELECT doc_id, doc_id % 4 = 0 AS readable FROM documents",
    "byte_patch_round_trip": f"""WITH t AS (SELECT doc_id, ({list(CHANGES)})[doc_id % 4 + 1] AS change, coalesce(text, '') AS t FROM documents)
SELECT doc_id, change, 'Ok' AS code, sha256(CASE change WHEN 'front' THEN 'header ' || t WHEN 'back' THEN t || ' trailer' WHEN 'both' THEN 'header ' || t || ' trailer' ELSE t END) AS sha256 FROM t""",
    "patch_faults": f"SELECT doc_id, ({list(FAULTS)})[doc_id % {len(FAULTS)} + 1] AS code FROM documents",
    "fault_categories": f"""WITH k(code, category, number) AS (VALUES {', '.join(f"('{k}', '{c}', CAST({n} AS BIGINT))" for k, (c, n) in (categories.PACKAGE | {'Ok': categories.NONE}).items())}),
f AS ({formats.SQL['package_faults']}) SELECT path, coalesce(category, 'Unknown') AS category, coalesce(number, 255) AS number FROM f LEFT JOIN k USING (code)""",
}
