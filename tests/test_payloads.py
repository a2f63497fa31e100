"""Hashes against published values, and codecs and patches on bytes of many kinds."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions import categories, codecs, digests
from granary.functions.digests import blake3, blake3_of
from granary.operators import patches
from granary.plans import payloads

# fixed values: the first 16 hex digits of BLAKE3 over bytes 0, 1, ... 250, 0, ... of these lengths
PUBLISHED = {
    0: "af1349b9f5f9a1a6", 1: "2d3adedff11b61f1", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3",
    2048: "e776b6028c7cd22a", 3073: "7124b49501012f81", 31744: "62b6960e1a44bcc1",
}


def counting(n):
    return bytes(i % 251 for i in range(n))


def samples():
    draw = random.Random(5)
    for size in (0, 1, 3, 4, 14, 15, 16, 19, 33, 273, 274, 5000, 40000):
        for kinds in (1, 2, 256):
            yield bytes(draw.randrange(kinds) for _ in range(size))
    yield bytes(draw.randrange(256) for _ in range(100)) * 900


def test_blake3_published(spark):
    assert [h.hex()[:16] for h in blake3([counting(n) for n in PUBLISHED])] == list(PUBLISHED.values())
    assert blake3([]) == [] and blake3([b"abc"])[0].hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    rows = spark.createDataFrame([(None,), (b"",), (counting(1025),)], "content binary").select("content", blake3_of("content").alias("h"))
    assert {r.content and len(r.content): r.h and bytes(r.h).hex()[:16] for r in rows.collect()} == {None: None, b"": PUBLISHED[0], 1025: PUBLISHED[1025]}


def test_round_trips():
    for data in samples():
        assert codecs.unpack(codecs.pack(data)) == data
        assert codecs.plain(codecs.wrap(data)) == data
        for target in (data, b"head" + data, data[: len(data) // 2] + b"zz" + data[len(data) // 2 :], data[1:], data + data, b"", data[::-1]):
            assert patches.apply(data, patches.create(data, target)) == ("Ok", target)


def test_small_where_it_can_be():
    data = counting(200) * 500
    assert len(codecs.wrap(data)) < 2000 and len(codecs.pack(data)) < 4000
    noise = random.Random(1).randbytes(100_000)
    assert codecs.wrap(noise) == noise and len(codecs.pack(noise)) == len(noise) + 6
    assert len(patches.create(noise, b"header" + noise)) < 150


@pytest.mark.parametrize("payload", [b"", b"\x01", b"\x00" * 9 + b"x", b"\x05" + bytes(7) + b"\x01\xff\xff", b"\x05" + bytes(7) + b"\x02abcde"])
def test_unwrap_refuses(payload):
    assert codecs.unwrap(payload) == (b"x" if payload[8:] == b"\x00x" else None)


def test_unpack_refuses():
    good = codecs.pack(b"abcdefgh" * 100)
    for bad in (b"\x02" + good[1:], good[:1] + b"\x01" + good[2:], good[:-1], good[:8], good[:12] + b"\x0f" * (len(good) - 12), good[:8] + b"\xff" + good[9:]):
        assert codecs.unpack(bad) is None
    assert codecs.unpack(good) == b"abcdefgh" * 100 and codecs.unpack(b"") == b""


def test_patch_limits(monkeypatch):
    patch = patches.create(b"", b"x" * 100)
    for name, most in (("MAX_PATCH", 80), ("MAX_INSERTED", 99), ("MAX_OPS", 0)):
        with monkeypatch.context() as m:
            m.setattr(patches, name, most)
            assert patches.apply(b"", patch) == ("DiffLimitsExceeded", None)


def test_null_and_empty_columns(spark):
    rows = spark.createDataFrame([(None, None), (b"a", None), (None, b"a")], "base binary, target binary")
    got = rows.withColumn("x", patches.patched("base", patches.patch_of("base", "target"))).select("target", "x.*").collect()
    assert all(r.code == "Ok" and bytes(r.content) == bytes(r.target or b"") for r in got)
    nulls = rows.limit(1).select(codecs.unpacked("base"), codecs.packed("base"), codecs.wrapped("base"), codecs.unwrapped("base"), codecs.restored("base"))
    assert set(nulls.first()) == {None}
    assert rows.where(F.lit(False)).select(codecs.packed("base")).count() == 0


@pytest.fixture
def steps(monkeypatch):
    """A list that gets an item at each hashing step."""
    found, step = [], digests._compress
    monkeypatch.setattr(digests, "_compress", lambda *x: found.append(1) or step(*x))
    return found


def test_patches_are_hashed_together(steps):
    bases = [counting(n) for n in range(0, 5000, 50)]
    targets = [b"header " + b for b in bases]
    made = patches.patch_of.func(pd.Series(bases), pd.Series(targets))
    got = patches.patched.func(pd.Series(bases), made)
    assert got.code.eq("Ok").all() and got.content.tolist() == targets
    assert len(steps) < 100  # for a pair alone 16 steps and more, three times


def test_damaged_patches_are_hashed_together(steps):
    bases = [counting(n) for n in range(20, 4020, 50)]
    made = [patches.create(b, b + b"!") for b in bases]
    heads = [m[:76] for m in made]
    bad = [
        m if k == 0 else b"J" + m[1:] if k == 1 else m[:8] + b"\x02" + m[9:] if k == 2 else m[:12] + bytes(32) + m[44:] if k == 3 else m[:44] + bytes(32) + m[76:] if k == 4
        else m[:75] if k == 5 else h + b"\x07" + m[77:] if k == 6 else h + b"\x00" + b"\xff" * 7 + b"\x7f\x01\x00\x00\x00"
        for k, m, h in zip([i % 8 for i in range(len(made))], made, heads, strict=True)
    ]
    steps.clear()
    got = patches.patched.func(pd.Series(bases), pd.Series(bad))
    assert got.code.tolist() == [payloads.FAULTS[i % 8] for i in range(len(bases))]
    assert [c for c in got.content if c is not None] == [b + b"!" for b in bases[::8]]
    assert len(steps) < 60  # for a base alone up to 18 steps


def test_long_lists_are_hashed_in_parts(monkeypatch):
    payloads = [counting(n) for n in (0, 5, 3000, 1024, 9000, 1, 1, 1, 0)]
    want = digests.blake3(payloads)
    monkeypatch.setattr(digests, "BATCH_BYTES", 2048)
    assert [list(x) for x in digests.batches([len(p) for p in payloads])] == [[0, 1], [2], [3], [4], [5, 6], [7, 8]]
    assert digests.blake3(payloads) == want == [digests.blake3([p])[0] for p in payloads]
    pairs = [(p, patches.create(p, p + b"!")) for p in payloads]
    assert patches.applied(pairs) == [("Ok", p + b"!") for p in payloads]


def test_copied_bytes_are_not_searched(monkeypatch):
    summed, sums = [], patches._sums
    monkeypatch.setattr(patches, "_sums", lambda data, *size: summed.append(len(data)) or sums(data, *size))
    base = random.Random(2).randbytes(50_000)
    copy = b"\0" + bytes(8) + len(base).to_bytes(4, "little")
    assert patches.create(base, base)[76:] == copy and patches.create(base, base + b"x")[76:] == copy + b"\1\1\0\0\0x"
    assert not summed
    assert patches.create(base, b"header " + base)[76:] == b"\1\7\0\0\0header " + copy
    assert sum(summed) < len(base) + 3 * patches.SLICE


def test_first_block_and_last_bytes_are_copied():
    draw = random.Random(4)
    block, other, end = draw.randbytes(4096), draw.randbytes(4096), draw.randbytes(32)
    base = other + block + block + end
    copy = lambda start, n: b"\0" + start.to_bytes(8, "little") + n.to_bytes(4, "little")
    assert patches.create(base, b"?" + block + b"!!" + end)[76:] == b"\1\1\0\0\0?" + copy(4096, 4096) + b"\1\2\0\0\0!!" + copy(12288, 32)
    assert patches.create(base, end + other[1:])[76:79] == b"\1" + (32 + 4095).to_bytes(2, "little")
    far = draw.randbytes(patches.WINDOW * 3)
    assert patches.create(base, far + block)[76 + 5 + len(far) :] == copy(4096, 4096)


def test_patch_sizes(spark, tmp_path):
    texts = ["", None, "abc" * 3000, "é" * 5000, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in enumerate(texts):
        base = (text or "").encode()
        target = {0: b"header " + base, 1: base + b" trailer", 2: b"header " + base + b" trailer", 3: base}[i % 4]
        n, size, patch, top = want.get(payloads.CHANGES[i % 4], (0, 0, 0, 0))
        now = len(patches.create(base, target))
        want[payloads.CHANGES[i % 4]] = (n + 1, size + len(target), patch + now, max(top, now))
    assert {r.change: tuple(r)[1:] for r in payloads.patch_sizes(spark, str(tmp_path)).collect()} == want


def test_categories(spark):
    cases = [("config", "Crc32Mismatch", ("InvalidChecksum", 7)), ("log", "Crc32Mismatch", ("InvalidChecksum", 6)), ("package", "CyclicDependency", ("DependencyError", 104))]
    cases += [("log", "EmptyChunk", ("Unknown", 255)), ("log", "Ok", ("None", 0)), ("config", None, None)]
    for name, code, want in cases:
        got = spark.createDataFrame([(code,)], "code string").select(categories.category_of(name, F.col("code"))).first()[0]
        assert got == want
