"""Files of the formats: written by one path, read by another, and each fault once."""

import struct
import zlib

from pyspark.sql import functions as F

from granary.sources import configs, logs, packages


def files(spark, contents):
    return spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content binary").repartition(2)


FIELDS = [configs.Field(0, configs.UINT), configs.Field(1, configs.TEXT, "name"), configs.Field(2, configs.ARRAY, "nodes", [configs.Field(0, configs.FLOAT)])]
ROOT = {0: configs.Unsigned(2**64 - 1), 1: "né", 2: [{0: -0.0}, None, {0: 1.5}], 7: b"\x00\xff", 300: True, 301: -5}


def test_config_values(spark):
    good = configs.encode(ROOT, FIELDS)
    bad = [good[:-1] + bytes([good[-1] ^ 1]), good.replace("né".encode(), b"n\xff\xff"), b"", good[:40], configs.encode({}, [], crc=False)]
    got = {}
    for r in configs.values(files(spark, [good, *bad])).collect():
        got.setdefault(r.path, {})[r.at] = (r.kind, r.value)
    assert got["0"] == {
        "$": ("object", "6"), "$.0": ("u64", str(2**64 - 1)), "$.1": ("string", "né"), "$.2": ("array", "3"), "$.2[0]": ("object", "1"), "$.2[0].0": ("f64", "0.0"), "$.2[1]": ("null", None),
        "$.2[2]": ("object", "1"), "$.2[2].0": ("f64", "1.5"), "$.7": ("bytes", "00ff"), "$.300": ("bool", "true"), "$.301": ("i64", "-5"),
    }
    assert [got[str(i)]["$"][1].split()[0] for i in range(1, 5)] == ["Crc32Mismatch", "InvalidString", "TruncatedFile", "TruncatedFile"]
    assert got["5"] == {"$": ("object", "0")}
    parts = {r.path: r for r in configs.blocks(files(spark, [good, good[:40]])).collect()}
    assert parts["0"].crc32 == zlib.crc32(good[:-4]) and bytes(parts["0"].schema)[0] == 3 and parts["1"].data is None


def test_config_header_faults(spark):
    good = configs.encode(ROOT, FIELDS)

    def put(at, *values):
        return good[:at] + bytes(values) + good[at + len(values) :]

    cases = [(good, "Ok", 0), (put(0, 0), "InvalidMagic", 0), (put(4, 3), "InvalidVersion", 4), (put(5, 9), "InvalidFlags", 5), (put(6, 1), "ReservedFieldNonzero", 6), (put(44, 1), "ReservedFieldNonzero", 44), (put(50, 1), "ReservedFieldNonzero", 48),
             (put(5, 0), "FlagMismatch", 5), (put(5, 3), "FlagMismatch", 5), (put(12, 0), "BoundsViolation", 12), (put(32, 0, 0), "BoundsViolation", 28), (put(16, 255, 255), "BoundsViolation", 12), (put(36, 65, 0), "BoundsViolation", 36), (put(8, 1), "BoundsViolation", 8), (good + b"x", "TruncatedFile", 0)]
    got = files(spark, [c for c, _, _ in cases]).select("path", configs.header_fault(F.col("content")).alias("f")).select("path", "f.*").collect()
    assert {int(r.path): (r.code, r.offset) for r in got} == {i: x[1:] for i, x in enumerate(cases)}


def test_logs(spark):
    data = bytes(range(256)) * 40
    made = [logs.encode(data, p) for p in logs.FLAGS] + [logs.encode(b"")]
    torn = made[1][:100] + b"\x07" + made[1][101:]
    df = files(spark, [*made, torn, made[0][:200], b"ILOG", made[0][:16] + b"X" + made[0][17:]])
    rows = logs.blocks(df)
    got = {r.path: (r.code, None if r.events is None else bytes(r.events)) for r in logs.events(rows).collect()}
    assert [got[str(i)] for i in range(4)] == [("Ok", data)] * 3 + [("Ok", b"")]
    index = sorted((r.entry, r.start, r.size) for r in logs.index_entries(rows).collect())
    assert index == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, len(data) + 13 - 8192)]
    codes = {r.path: r.code for r in logs.faults(df).collect()}
    assert [codes[str(i)] for i in range(8)] == ["Ok"] * 4 + ["Crc32Mismatch", "CorruptedHeader", "CorruptedHeader", "MalformedBlock"]
    assert {r.path: r.code for r in logs.faults(df, strict=False).collect()}["4"] == "Ok"


def test_packages(spark):
    parts = [b"aaa", b"", b"cc" * 50]
    good = packages.encode(parts, [(0, 1), (1, 2)], [2, 0, 1], 2)
    at = packages.HEAD[2]
    entry = lambda i: at + packages.ENTRY * i
    swap = lambda raw, at, new: raw[:at] + new + raw[at + len(new) :]
    cases = [
        (good, "Ok"), (packages.encode(parts), "Ok"), (packages.encode(parts, profile=1), "ProfileNotAllowed"), (packages.encode(parts, profile=9), "InvalidFlags"),
        (swap(good, entry(1), struct.pack("<I", 5)), "ChunkIndexError"), (swap(good, entry(0) + 12, struct.pack("<Q", 10**6)), "OffsetOutOfBounds"), (packages.encode(parts, [(0, 3)], profile=2), "InvalidDependency"),
        (packages.encode(parts, [(1, 1)], profile=2), "InvalidDependency"), (packages.encode(parts, [], [0, 1], 2), "MissingChunkInApplyOrder"), (packages.encode(parts, [], [0, 0, 1], 2), "DuplicateChunkInApplyOrder"),
        (good[:-1] + b"x", "Crc32Mismatch"), (good[:20], "OffsetOutOfBounds"), (b"", "OffsetOutOfBounds"), (b"NOPE!", "InvalidMagic"),
    ]
    overlap = struct.unpack_from("<Q", good, entry(2) + 12)[0]
    cases.append((swap(good, entry(0) + 12, struct.pack("<Q", overlap + 1)), "OverlappingPayloads"))
    df = files(spark, [c for c, _ in cases])
    got = {int(r.path): r.code for r in packages.faults(df).collect()}
    assert got == {i: c for i, (_, c) in enumerate(cases)}
    one = df.where("path = '0'")
    assert [(r.chunk, bytes(r.payload)) for r in packages.applied(one).orderBy("place").collect()] == [(2, parts[2]), (0, parts[0]), (1, parts[1])]
    assert sorted((r.source, r.target) for r in packages.edges(one).collect()) == [(0, 1), (1, 2)]
