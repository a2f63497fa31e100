"""Queries on values, paths, profiles and gates of structured files, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars, variants
from granary.operators import gates
from granary.operators.ordered import running
from granary.operators.staging import staged
from granary.sources import configs, logs, packages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# fixed values: format magics, package profiles with their codes and capabilities, log profiles with their flags
MAGICS = {"ICF2": "icf2", "ICFX": "icfx", "ICXS": "icxs", "ICFS": "bjx", "BJV2": "bjv", "BJV4": "bjv", "ILOG": "ilog", "IUPD": "iupd"}
PACKAGE_PROFILES = {0: "MINIMAL", 1: "FAST", 2: "SECURE", 3: "OPTIMIZED", 4: "INCREMENTAL"}
COMPRESSED, STRICT = ("FAST", "OPTIMIZED", "INCREMENTAL"), ("SECURE", "OPTIMIZED", "INCREMENTAL")
LOG_FLAGS = {"MINIMAL": 0x01, "INTEGRITY": 0x03, "SEARCHABLE": 0x09, "ARCHIVED": 0x11, "AUDITED": 0x27}


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON object and length of a JSON array."""
    return _table(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("fields"), F.json_array_length(F.concat(F.lit("["), "props", F.lit(","), "props", F.lit(",3]"))).cast("long").alias("items"))


#: Steps, wanted kind, and the same path for the SQL.
PATHS = (
    (("n", "k"), "BIGINT", "$.n.k"),
    (("a", 1, "b"), "STRING", "$.a[1].b"),
    (("a", 1, "b"), "BIGINT", "$.a[1].b"),
    (("a", 7, "b"), "STRING", "$.a[7].b"),
    (("a", "b"), "STRING", "$.a.b"),
    (("n", 0), "BIGINT", "$.n[0]"),
    (("z",), "BIGINT", "$.z"),
)


def path_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by keys and indexes, with no implicit cast, or why there is none."""
    doc = F.concat(F.lit('{"a":[{"b":1},{"b":"'), "event_type", F.lit('"}],"n":'), "props", F.lit("}"))
    rows = _table(spark, sf_dir, "events").withColumn("v", F.parse_json(doc))
    each = [F.struct(F.lit(f"{p} {kind}").alias("path"), variants.navigate(F.col("v"), steps, kind).alias("code"), variants.value_at(F.col("v"), steps, kind).alias("value")) for steps, kind, p in PATHS]
    return rows.select("event_id", F.inline(F.array(*each)))


def profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages by the capabilities of their profile; a profile may be opened if it is strict."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_size", F.lit(6)).alias("code"))
    name = F.element_at(F.create_map(*(F.lit(x) for kv in PACKAGE_PROFILES.items() for x in kv)), F.col("code"))
    rows = rows.withColumn("profile", name)
    strict = F.coalesce(F.col("profile").isin(*STRICT), F.lit(False))
    error = F.when(F.col("profile").isNull(), "InvalidFlags").when(~strict, "ProfileNotAllowed").otherwise("Ok")
    return rows.select("p_partkey", "profile", F.coalesce(F.col("profile").isin(*COMPRESSED), F.lit(False)).alias("compresses"), strict.alias("signed"), error.alias("opens"))


def log_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities of log profiles from the bits of their flags."""
    names = F.array(*(F.lit(n) for n in LOG_FLAGS))
    flag = F.create_map(*(F.lit(x) for kv in LOG_FLAGS.items() for x in kv))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(names, F.pmod("n_nationkey", F.lit(5)) + 1).alias("profile")).withColumn("flags", flag[F.col("profile")])
    bit = lambda i: F.col("flags").bitwiseAND(F.lit(1 << i)) != 0
    return rows.select("n_nationkey", "profile", "flags", bit(1).alias("crc32"), bit(2).alias("blake3"), bit(3).alias("index"), bit(4).alias("archive"), bit(5).alias("witness"))


def usable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose median is positive and whose values are all there."""
    good = F.percentile("value", 0.5)
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(good, 6).alias("median"), F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("n"))
    return rows.where("median > 30 AND missing = 0").select("user_id", "median", "n")


def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two runs gave the same bytes for a document; a missing side is a failure."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    one = docs.select("doc_id", F.sha2("text", 256).alias("a"))
    two = labels.join(docs, "doc_id").select("doc_id", F.sha2(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text")), 256).alias("b"))
    return gates.same_values(one, two, ["doc_id"], "a", "b").select("doc_id", "status")


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources compared path by path."""
    def paths(df: DataFrame, key: str, nation: str, name: str) -> DataFrame:
        pick = F.array(F.struct(F.lit("$.nation").alias("path"), F.col(nation).cast("string").alias(name)), F.struct(F.lit("$.digits").alias("path"), F.length(key + "_s").cast("string").alias(name)))
        return df.withColumn(key + "_s", F.col(key).cast("string")).select(F.col(key).alias("key"), F.inline(pick))

    both = gates.same_values(paths(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "x"), paths(_table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "y"), ["key", "path"], "x", "y")
    return both.groupBy("path", "status").agg(F.count("*").alias("n"))


#: Resamples of the bootstrap, and its seed.
RESAMPLES, SEED = 1000, 42


def median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the median of the nations' median balances."""
    medians = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.percentile("c_acctbal", 0.5).alias("v"))
    return gates.median_interval(medians, "c_nationkey", "v", RESAMPLES, SEED)


def language_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average sizes and ratios of each format (here: language)."""
    n, b = F.length("text"), F.octet_length("text")
    rows = _table(spark, sf_dir, "documents").where(n > 0)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("chars"), F.round(F.avg(b), 6).alias("bytes"), F.round(F.avg(b / n), 6).alias("ratio"))


def byte_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the 256 byte values that occur, and whether it is credible."""
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.distinct_byte_ratio(F.col("text")).alias("ratio")).withColumn("credible", F.col("ratio") >= 0.1)


def ascending_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of strictly ascending order, and entries whose index isn't their place, by order."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey")
    placed = running(lines, ["l_orderkey"], ["l_linenumber", "l_partkey"], lags=["l_partkey"])
    falls = F.coalesce(F.col("last_l_partkey") >= F.col("l_partkey"), F.lit(False))
    return placed.groupBy("l_orderkey").agg(F.count_if(falls).alias("falls"), F.count_if(F.col("position") != F.col("l_linenumber")).alias("misplaced"))


def trust_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trust store for each nation as canonical JSON: sorted, without repeats or white space."""
    rows = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("keys"), F.sort_array(F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")))).alias("revoked"))
    return rows.select("c_nationkey", F.to_json(F.struct("keys", "revoked", F.lit(1).alias("version"))).alias("store"))


def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of several sources, with how many sources have each."""
    of = lambda t, c: _table(spark, sf_dir, t).select(F.col(c).alias("key"), F.lit(t).alias("source")).distinct()
    return of("region", "r_name").union(of("nation", "n_name")).union(of("customer", "c_mktsegment")).union(of("events", "event_type")).groupBy("key").agg(F.count("*").alias("sources"))


def clean_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus zero becomes zero; NaN is refused."""
    x = F.when(F.col("l_tax") == 0, F.col("l_discount") * F.lit(-0.0)).when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.lit(-1.0))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return rows.select("l_orderkey", "l_linenumber", scalars.clean_float(F.col("x")).cast("string").alias("x"), F.when(F.isnan("x"), "InvalidFloat").otherwise("Ok").alias("code"))


def hex_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ids must be 32 lower-case hex digits."""
    h = F.md5("text")
    made = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, F.substring(h, 1, 31)).otherwise(h)
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(scalars.is_hex(made, 32)).alias("valid"), F.count("*").alias("n"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, no white space, bytes as base64."""
    rows = _table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.to_json(F.struct(F.concat(F.lit("b64:"), F.base64(F.encode("p_name", "UTF-8"))).alias("blob"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("json"))


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of labels such as 10KB; 0 for what is no label."""
    label = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "XB", ""))), F.pmod("p_partkey", F.lit(5)).cast("int") + 1))
    return _table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), scalars.size_of_label(label).alias("bytes"))


def normalized_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds and bytes a KB, and size against the input."""
    n, b = F.length("text"), F.octet_length("text")
    return _table(spark, sf_dir, "documents").where(n > 0).select("doc_id", (F.col("doc_id") * 1000 / (b / 1024)).alias("us_per_kb"), (b / (n / 1024)).alias("bytes_per_kb"), (b / n).alias("ratio"))


def fairness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of 1024 bytes at least that come back from their encoding unchanged."""
    raw = F.encode("text", "UTF-8")
    coded = F.base64(raw)
    ok = (F.octet_length("text") >= 1024) & (F.length(coded) > 0) & (F.sha2(F.unbase64(coded), 256) == F.sha2(raw, 256))
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(ok, F.lit(False)).alias("fair"))


def credibility_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets with over 5 keys, depth 2, over 50 events and a tenth of the byte values."""
    rows = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("keys"), F.max(F.length(F.regexp_replace("props", r"[^{\[]", "")) + 1).cast("long").alias("depth"))
    return rows.withColumn("credible", (F.col("keys") > 5) & (F.col("depth") >= 2) & (F.col("events") > 2000))


def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by the first four bytes, and a report with an exit code."""
    heads = [*MAGICS, "JUNK", "IL"]
    head = F.element_at(F.array(*map(F.lit, heads)), F.pmod("p_partkey", F.lit(len(heads))).cast("int") + 1)
    content = F.when(head == "IL", head).otherwise(F.concat(head, "p_name"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.encode(content, "UTF-8").alias("content")).withColumn("engine", scalars.format_of(F.col("content"), MAGICS))
    ok = F.col("engine") != "unknown"
    report = F.to_json(F.struct(ok.alias("ok"), F.col("engine"), F.octet_length("content").alias("bytes_scanned"), F.when(ok, "").otherwise("InvalidMagic").alias("error")))
    return rows.select("p_partkey", "engine", report.alias("report"), F.when(ok, 0).otherwise(1).alias("exit_code"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, CSV and Markdown."""
    cols = ["n_nationkey", "n_name", "n_regionkey"]
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(*cols)).alias("json"), F.concat_ws(",", *cols).alias("csv"), F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |")).alias("markdown"))


def packed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal varints and little-endian bytes of numbers, as hex, and the numbers read back."""
    n = F.col("o_orderkey") * F.col("o_custkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).where("n < 4294967296")
    packed = rows.withColumn("varint", scalars.varint_hex(F.col("n"))).withColumn("le", scalars.little_endian_hex(F.col("n")))
    return packed.withColumn("back", scalars.varint_value(F.col("varint")))


def type_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by their number in the sorted dictionary, and back."""
    events = _table(spark, sf_dir, "events")
    names = running(events.select("event_type").where("event_type is not null").distinct(), [], ["event_type"]).select("event_type", (F.col("position") - 1).alias("id"))
    coded = events.join(names, "event_type").select("event_id", "id")
    return coded.join(names, "id").select("event_id", "id", "event_type")


def index_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of 13 pairs or more get a hash index of twice the next power of two."""
    pairs = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("pairs"))
    slots = F.greatest(F.lit(8), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("pairs") * 2.0) - 1e-9)).cast("long"))
    return pairs.select("o_custkey", "pairs", F.when(F.col("pairs") >= 13, "indexed").otherwise("linear").alias("kind"), slots.cast("long").alias("slots"))


def first_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each type: its number and payload."""
    first = F.min(F.struct("event_id", "props"))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(first.alias("x")).select("event_type", "x.event_id", "x.props")


def codec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes, upper median, both variations (infinite or 0 for a mean of 0) and passes of each group."""
    return gates.codec_summary(_table(spark, sf_dir, "events"), ["event_type"], "value")


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as config files and read back value by value."""
    files = configs.files(_table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text", "lang"])
    return configs.values(files).select("path", "at", "kind", F.md5("value").alias("value_md5"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as indexed log files: their events, and the entries of their index."""
    files = logs.files(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("events")), "SEARCHABLE")
    blocks = staged(logs.blocks(files), "log-blocks")
    entries = logs.index_entries(blocks).groupBy("path").agg(F.count("*").alias("entries"), F.sum("size").alias("indexed"))
    return logs.events(blocks).join(entries, "path").select("path", "code", F.sha2("events", 256).alias("sha256"), "entries", "indexed")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each order, the chunks being its lines; a fifth is damaged in one way or another."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    chunk = F.transform("x", lambda c: F.encode(F.concat(F.lit("part "), c["l_partkey"].cast("string")), "UTF-8"))
    places = F.reverse(F.sequence(F.lit(0), F.size("x") - 1))
    files = packages.files(lines.select(F.col("l_orderkey").alias("path"), chunk.alias("chunks"), places.alias("places")), 2)
    kind = F.pmod(F.col("path").cast("long"), F.lit(10))
    c = F.col("content")
    cut = F.when(kind == 1, F.expr("substring(content, 1, octet_length(content) - 1)")).when(kind == 2, F.concat(F.encode(F.lit("X"), "UTF-8"), F.expr("substring(content, 2)"))).otherwise(c)
    return staged(files.select("path", cut.alias("content")), "packages")


def package_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each package that opens, in the order they are applied."""
    return packages.applied(_packages(spark, sf_dir)).select("path", "place", "chunk", F.decode("payload", "UTF-8").alias("payload"))


def package_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each package."""
    return packages.faults(_packages(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        value_counts, path_refusals, profile_matrix, log_flags, usable_groups, run_digests, parity, median_interval, language_averages, byte_ratio, ascending_fields, trust_documents, key_union, clean_floats, hex_checks,
        canonical_json, size_labels, normalized_metrics, fairness_gate, credibility_gates, detected_formats, report_lines, packed_numbers, type_ids, index_choice, first_payloads, codec_summary,
        config_values, log_events, package_order, package_faults,
    )
}


def _cases(pairs: dict, what: str, default: str) -> str:
    return f"CASE {what} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{default}' END"


def _path_sql(steps: tuple, kind: str, path: str) -> str:
    at, tests = "$", []
    for s in steps:
        want = "OBJECT" if isinstance(s, str) else "ARRAY"
        tests.append(f"WHEN json_type(v, '{at}') <> '{want}' THEN 'FieldTypeMismatch'")
        at += f".{s}" if isinstance(s, str) else f"[{s}]"
        tests.append(f"WHEN json_type(v, '{at}') IS NULL THEN '{'UnknownField' if isinstance(s, str) else 'BoundsViolation'}'")
    kinds = {"BIGINT": "('BIGINT', 'UBIGINT')", "STRING": "('VARCHAR')"}[kind]
    tests.append(f"WHEN json_type(v, '{at}') NOT IN {kinds} THEN 'FieldTypeMismatch'")
    code = f"CASE {' '.join(tests)} ELSE 'Ok' END"
    return f"SELECT event_id, '{path} {kind}' AS path, {code} AS code, CASE WHEN ({code}) = 'Ok' THEN json_extract_string(v, '{path}') END AS value FROM j"


SQL: dict[str, str] = {
    "value_counts": "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS fields, CAST(json_array_length('[' || props || ',' || props || ',3]') AS BIGINT) AS items FROM events",
    "path_refusals": """WITH j AS (SELECT event_id, CAST('{"a":[{"b":1},{"b":"' || event_type || '"}],"n":' || props || '}' AS JSON) AS v FROM events) """ + " UNION ALL ".join(_path_sql(*p) for p in PATHS),
    "profile_matrix": "WITH p AS (SELECT p_partkey, CASE p_size % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PACKAGE_PROFILES.items()) + f""" END AS profile FROM part)
SELECT p_partkey, profile, coalesce(profile IN {COMPRESSED}, false) AS compresses, coalesce(profile IN {STRICT}, false) AS signed,
  CASE WHEN profile IS NULL THEN 'InvalidFlags' WHEN profile NOT IN {STRICT} THEN 'ProfileNotAllowed' ELSE 'Ok' END AS opens FROM p""",
    "log_flags": f"""WITH p AS (SELECT n_nationkey, ({list(LOG_FLAGS)})[n_nationkey % 5 + 1] AS profile, ({list(LOG_FLAGS.values())})[n_nationkey % 5 + 1] AS flags FROM nation)
SELECT n_nationkey, profile, flags, flags & 2 <> 0 AS crc32, flags & 4 <> 0 AS blake3, flags & 8 <> 0 AS "index", flags & 16 <> 0 AS archive, flags & 32 <> 0 AS witness FROM p""",
    "usable_groups": "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM events GROUP BY user_id HAVING round(quantile_cont(value, 0.5), 6) > 30 AND count(*) = count(value)",
    "run_digests": """WITH a AS (SELECT doc_id, sha256(text) AS a FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN upper(text) ELSE text END) AS b FROM labels JOIN documents USING (doc_id))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'MISSING_RIGHT' WHEN a.doc_id IS NULL THEN 'MISSING_LEFT' WHEN a.a IS NOT DISTINCT FROM b.b THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "parity": """WITH a AS (SELECT s_suppkey AS key, '$.nation' AS path, CAST(s_nationkey AS VARCHAR) AS x FROM supplier UNION ALL SELECT s_suppkey, '$.digits', CAST(length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR) FROM supplier),
b AS (SELECT c_custkey AS key, '$.nation' AS path, CAST(c_nationkey AS VARCHAR) AS y FROM customer UNION ALL SELECT c_custkey, '$.digits', CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR) FROM customer)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.key IS NULL THEN 'MISSING_RIGHT' WHEN a.key IS NULL THEN 'MISSING_LEFT' WHEN x IS NOT DISTINCT FROM y THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) AS n FROM a FULL JOIN b ON a.key = b.key AND a.path = b.path GROUP BY 1, 2""",
    "median_interval": f"""WITH m AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS v FROM customer GROUP BY 1), p AS (SELECT v, row_number() OVER (ORDER BY c_nationkey) - 1 AS pos FROM m), n AS (SELECT count(*) AS n FROM m),
d AS (SELECT r, ((r * 1103515245 + i * 12345 * (r + 7) + {SEED}) % 2147483648) // 8 % n AS pos FROM n, unnest(range({RESAMPLES})) AS a(r), unnest(range(n)) AS b(i)),
s AS (SELECT r, quantile_cont(v, 0.5) AS v FROM d JOIN p USING (pos) GROUP BY r)
SELECT (SELECT round(quantile_cont(v, 0.5), 6) FROM m) AS median, round(list_sort(list(v))[CAST(ceil(0.025 * (count(*) - 1)) AS INT) + 1], 6) AS lo, round(list_sort(list(v))[CAST(ceil(0.975 * (count(*) - 1)) AS INT) + 1], 6) AS hi FROM s""",
    "language_averages": "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS chars, round(avg(strlen(text)), 6) AS bytes, round(avg(strlen(text) / length(text)), 6) AS ratio FROM documents WHERE length(text) > 0 GROUP BY lang",
    "byte_ratio": "SELECT doc_id, len(list_distinct(regexp_extract_all(hex(encode(text)), '..'))) / 256 AS ratio, len(list_distinct(regexp_extract_all(hex(encode(text)), '..'))) / 256 >= 0.1 AS credible FROM documents",
    "ascending_fields": """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER w AS last, row_number() OVER w AS pos FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
SELECT l_orderkey, count(*) FILTER (WHERE last >= l_partkey) AS falls, count(*) FILTER (WHERE pos <> l_linenumber) AS misplaced FROM p GROUP BY 1""",
    "trust_documents": """SELECT c_nationkey, '{"keys":["' || list_aggregate(list_sort(list(DISTINCT c_mktsegment)), 'string_agg', '","') || '"],"revoked":[' || coalesce('"' || list_aggregate(list_sort(list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal < 0)), 'string_agg', '","') || '"', '') || '],"version":1}' AS store FROM customer GROUP BY 1""",
    "key_union": "SELECT key, count(*) AS sources FROM (SELECT DISTINCT r_name AS key, 1 AS s FROM region UNION ALL SELECT DISTINCT n_name, 2 FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 3 FROM customer UNION ALL SELECT DISTINCT event_type, 4 FROM events) GROUP BY key",
    "clean_floats": """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN '0.0' WHEN l_discount = 0 THEN NULL ELSE '-1.0' END AS x, CASE WHEN l_tax <> 0 AND l_discount = 0 THEN 'InvalidFloat' ELSE 'Ok' END AS code FROM lineitem""",
    "hex_checks": """SELECT lang, count(*) FILTER (WHERE regexp_full_match(CASE doc_id % 3 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN substr(md5(text), 1, 31) ELSE md5(text) END, '[0-9a-f]{32}')) AS valid, count(*) AS n FROM documents GROUP BY lang""",
    "canonical_json": """SELECT p_partkey, '{"blob":"b64:' || base64(encode(p_name)) || '","brand":"' || p_brand || '","size":' || p_size || '}' AS json FROM part""",
    "size_labels": """WITH l AS (SELECT p_partkey, p_size, p_size || (['B', 'KB', 'MB', 'XB', ''])[p_partkey % 5 + 1] AS label FROM part)
SELECT p_partkey, label, CASE WHEN regexp_full_match(label, '[0-9]+(B|KB|MB)') THEN p_size * CASE regexp_extract(label, '[A-Z]+') WHEN 'B' THEN 1::BIGINT WHEN 'KB' THEN 1024 ELSE 1048576 END ELSE 0 END AS bytes FROM l""",
    "normalized_metrics": "SELECT doc_id, doc_id * 1000 / (strlen(text) / 1024) AS us_per_kb, strlen(text) / (length(text) / 1024) AS bytes_per_kb, strlen(text) / length(text) AS ratio FROM documents WHERE length(text) > 0",
    "fairness_gate": "SELECT doc_id, coalesce(strlen(text) >= 1024 AND sha256(from_base64(base64(encode(text)))) = sha256(encode(text)), false) AS fair FROM documents",
    "credibility_gates": """WITH e AS (SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS keys, CAST(max(length(regexp_replace(props, '[^{\\[]', '', 'g')) + 1) AS BIGINT) AS depth FROM events GROUP BY 1) SELECT *, keys > 5 AND depth >= 2 AND events > 2000 AS credible FROM e""",
    "detected_formats": f"""WITH h AS (SELECT p_partkey, p_name, ({[*MAGICS, 'JUNK', 'IL']})[p_partkey % 10 + 1] AS head FROM part), c AS (SELECT p_partkey, CASE WHEN head = 'IL' THEN head ELSE head || p_name END AS content FROM h),
e AS (SELECT *, {_cases(MAGICS, "substr(content, 1, 4)", "unknown")} AS engine FROM c)
SELECT p_partkey, engine, '{{"ok":' || (engine <> 'unknown') || ',"engine":"' || engine || '","bytes_scanned":' || strlen(content) || ',"error":"' || CASE WHEN engine = 'unknown' THEN 'InvalidMagic' ELSE '' END || '"}}' AS report, CASE WHEN engine = 'unknown' THEN 1 ELSE 0 END AS exit_code FROM e""",
    "report_lines": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json, n_nationkey || ',' || n_name || ',' || n_regionkey AS csv, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS markdown FROM nation""",
    "packed_numbers": """WITH o AS (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders WHERE o_orderkey * o_custkey < 4294967296)
SELECT o_orderkey, n, list_aggregate(list_transform(list_filter(range(5), lambda i: i = 0 OR n >> CAST(7 * i AS INT) > 0), lambda i: printf('%02X', CAST(((n >> CAST(7 * i AS INT)) & 127) | CASE WHEN n >> CAST(7 * i + 7 AS INT) > 0 THEN 128 ELSE 0 END AS BIGINT))), 'string_agg', '') AS varint,
  list_aggregate(list_reverse(regexp_extract_all(printf('%016X', n), '..')), 'string_agg', '') AS le, n AS back FROM o""",
    "type_ids": "WITH d AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)) SELECT event_id, id, event_type FROM events JOIN d USING (event_type)",
    "index_choice": "SELECT o_custkey, count(*) AS pairs, CASE WHEN count(*) >= 13 THEN 'indexed' ELSE 'linear' END AS kind, greatest(8, CAST(pow(2, ceil(log2(count(*) * 2.0) - 1e-9)) AS BIGINT)) AS slots FROM orders GROUP BY 1",
    "first_payloads": "SELECT event_type, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY 1",
    "codec_summary": """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, min(value) AS lo, round(max(value) FILTER (WHERE pos = n // 2 + 1), 6) AS upper_median, max(value) AS hi, round(stddev_pop(value) / avg(value), 6) AS cv, round(stddev_pop(value) / avg(value), 6) AS cv_or_zero, count(*) FILTER (WHERE value > 0) AS passes, stddev_pop(value) / avg(value) <= 0.15 AS stable FROM p GROUP BY 1""",
    "config_values": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, * FROM documents)
SELECT path, '$' AS at, 'object' AS kind, md5('3') AS value_md5 FROM d UNION ALL SELECT path, '$.0', 'i64', md5(path) FROM d
UNION ALL SELECT path, '$.1', CASE WHEN text IS NULL THEN 'null' ELSE 'string' END, md5(text) FROM d UNION ALL SELECT path, '$.2', CASE WHEN lang IS NULL THEN 'null' ELSE 'string' END, md5(lang) FROM d""",
    "log_events": "SELECT CAST(doc_id AS VARCHAR) AS path, 'Ok' AS code, sha256(coalesce(text, '')) AS sha256, CAST((strlen(coalesce(text, '')) + 13 + 4095) // 4096 AS BIGINT) AS entries, CAST(strlen(coalesce(text, '')) + 13 AS BIGINT) AS indexed FROM documents",
    "package_order": """WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS chunk, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS path, n - 1 - chunk AS place, chunk, CASE WHEN l_orderkey % 10 = 1 AND chunk = 0 THEN NULL ELSE 'part ' || l_partkey END AS payload FROM l WHERE l_orderkey % 10 <> 2""",
    "package_faults": "SELECT CAST(l_orderkey AS VARCHAR) AS path, CASE l_orderkey % 10 WHEN 1 THEN 'OffsetOutOfBounds' WHEN 2 THEN 'InvalidMagic' ELSE 'Ok' END AS code FROM (SELECT DISTINCT l_orderkey FROM lineitem)",
}
