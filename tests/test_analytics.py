"""Operators on small tables with nulls, ties, hot groups and no rows at all."""

import random

from pyspark.sql import functions as F

from granary.operators import checks, chunks, stats
from granary.operators.ordered import at_ranks, running


def test_running_over_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}" if i % 5 else None, i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, o long, v long")
    got = {(r.g, r.o): r for r in running(df, ["g"], ["o"], sums=["v"], maxes=["v"], lags=["v"]).collect()}
    assert len(got) == len(data)
    seen = {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        before = seen.setdefault(g, [])
        r = got[g, o]
        assert (r.position, r.before_v, r.top_v, r.last_v) == (len(before) + 1, sum(before), max(before, default=None), before[-1] if before else None)
        before.append(v)


def test_running_without_group_and_without_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"))
    assert all(r.position == r.o + 1 and (r.last_o == r.o - 1 if r.o else r.last_o is None) for r in running(df, [], ["o"], lags=["o"]).collect())
    assert running(df.where("o < 0"), [], ["o"], lags=["o"]).count() == 0


def test_at_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", None), (None, 2.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.median, r.p) for r in at_ranks(df, ["g"], "v", p=0.95).collect()}
    assert got == {"a": (3, 1.0, 5.0), None: (1, 2.0, 2.0)}


def test_trim_rejects_where_too_few_stay(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 100, 200)] + [("b", 5.0)] * 3, "g string, v double")
    got = {r.g: (r.n, r.kept, r.accepted) for r in stats.trim(df, ["g"], "v").collect()}
    assert got == {"a": (5, 3, False), "b": (3, 3, True)}


def test_delta_round_trip(spark):
    rng = random.Random(2)
    old = {1: rng.randbytes(9000), 2: b"", 3: rng.randbytes(5000), 4: rng.randbytes(4096)}
    new = {1: old[1][:4100] + b"!" + old[1][4101:], 2: rng.randbytes(3), 3: old[3][:4096], 4: old[4]}
    make = lambda d: spark.createDataFrame([(k, bytearray(v)) for k, v in d.items()], "k long, payload binary")
    changes = chunks.delta(make(old), make(new), "k")
    assert {(r.k, r.chunk) for r in changes.collect()} == {(1, 1), (2, 0), (3, 1)}
    assert {r.k: bytes(r.payload) for r in chunks.patched(make(old), changes, "k").collect()} == new


def test_order_gaps(spark):
    df = spark.createDataFrame([("ok", 1), ("ok", 2), ("twice", 1), ("twice", 1), ("gap", 3), ("low", 0), ("low", 1)], "g string, n long")
    got = {r.g: (r.n, r.out_of_range, r.repeated, r.missing) for r in checks.order_gaps(df, ["g"], "n").collect()}
    assert got == {"twice": (2, 0, 1, 0), "gap": (1, 0, 0, 2), "low": (2, 1, 0, 0)}


def test_replay_guard(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("a", 4, 7), ("b", 1, 1)], "k string, t long, s long")
    got = {(r.k, r.t): r.accepted for r in checks.replay_guard(df, ["k"], "t", "s").collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): True}


def test_payload_crc32(spark):
    import zlib

    from granary.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.crc32 for r in catalog.QUERIES["payload_crc32"](spark, sf).collect()}
    assert got == {k: None if t is None else zlib.crc32(t.encode()) for k, t in texts.items()}


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 0.0), ("a", 0.0)], "g string, v double")
    got = {r.g: r for r in stats.summary(df, ["g"], "v").collect()}
    assert got[None].median == 2.0 and got[None].n == 2 and got["a"].cv == float("inf")
    assert {r.g: (r.n, r.kept) for r in stats.trim(df, ["g"], "v").collect()} == {None: (2, 2), "a": (2, 2)}


def test_gate_without_comparisons_fails(spark):
    gate = spark.createDataFrame([("PASS",), ("WARN",)], "status string")
    assert [stats.gate_verdict(g).first().verdict for g in (gate, gate.where("status = 'PASS'"), gate.where("false"))] == ["WARN", "PASS", "FAIL"]


def test_varints_and_paths(spark):
    from granary.functions import scalars, variants

    df = spark.createDataFrame([("00", 0), ("7F", 127), ("8001", 128), ("FFFFFFFF0F", 2**32 - 1), ("8000", None), ("80", None), ("", None), ("808080808001", None)], "h string, n long")
    got = df.select("h", "n", scalars.varint_value(F.col("h")).alias("back"), scalars.varint_hex(F.col("n")).alias("hex")).collect()
    assert all(r.back == r.n for r in got) and all(r.hex == r.h for r in got if r.n is not None)
    v = spark.createDataFrame([('{"a":[{"b":"x"},2]}',), ("[]",), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in v.select(variants.navigate(F.col("v"), ("a", 0, "b"), "STRING")).collect()][:2] == ["Ok", "FieldTypeMismatch"]
    assert [r[0] for r in v.select(variants.navigate(F.col("v"), ("a", 5), "STRING")).collect()][:2] == ["BoundsViolation", "FieldTypeMismatch"]
