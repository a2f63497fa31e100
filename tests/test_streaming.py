from granary.operators.chunks import copy_ops, replayed
from granary.streaming.guard import guard_stream


def test_guard_keeps_state_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([("a", 1, 5), ("a", 2, 4), ("b", 3, 1)], [("a", 4, 5), ("a", 5, 6), ("b", 6, 2), (None, 7, 1)]):
        spark.createDataFrame(rows, "k string, t long, s long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t long, s long").parquet(source)
        guard_stream(stream, "k", "t", "s", str(tmp_path / "out")).awaitTermination()
    got = {r.t: r.accepted for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True}


def test_copy_ops_move_and_repeat_chunks(spark):
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    old, new = {1: a + b + a + c, 2: a, 3: b""}, {1: c + a + b + b + b"x" * 20, 2: b"", 3: a}
    make = lambda d: spark.createDataFrame([(k, bytearray(v)) for k, v in d.items()], "k long, payload binary")
    ops = copy_ops(make(old), make(new), "k", 16)
    assert [(r.op, r.kind, r["from"], r.size) for r in ops.where("k = 1").orderBy("op").collect()] == [(1, "COPY", 48, 16), (2, "COPY", 0, 32), (3, "COPY", 16, 16), (4, "LITERAL", None, 20)]
    assert {r.k: bytes(r.payload) for r in replayed(make(old), ops, "k").collect()} == {k: v for k, v in new.items() if v}
