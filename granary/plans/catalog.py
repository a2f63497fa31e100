"""Registered queries of the analytics layer and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import checks, chunks, stats
from granary.operators.ordered import at_ranks, running
from granary.operators.staging import shared_folder
from granary.plans import formats, payloads
from granary.streaming.guard import guard_stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, extremes and mean of the values of each kind of event."""
    return (
        _events(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and median absolute deviation of each kind of event."""
    off = stats.deviations(_events(spark, sf_dir), ["event_type"], "value")
    return off.groupBy("event_type").agg(F.round(F.first("mid"), 6).alias("mid"), F.round(F.first("mad"), 6).alias("mad"))


def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed value by its path in each JSON document; null where it is missing."""
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and size of each 4096-byte slice of a payload."""
    n = F.octet_length("text")
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 4096).cast("int")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), F.explode(at).alias("i"))
    return docs.select("doc_id", (F.col("i") * 4096).cast("long").alias("offset"), F.least(F.lit(4096), F.col("n") - F.col("i") * 4096).cast("long").alias("size"))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full summary of the prices of each return flag."""
    made = stats.summary(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return made.select("l_returnflag", "n", "lo", "hi", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "median")), F.round("cv", 8).alias("cv"), "p95")


def ceil_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at the ceil ranks of three fractions, by kind of event."""
    return at_ranks(_events(spark, sf_dir), ["event_type"], "value", p50=0.5, p95=0.95, p99=0.99).drop("median")


def outlier_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each kind of event lie within three deviations of the median."""
    return stats.trim(_events(spark, sf_dir), ["event_type"], "value")


def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users ranked in each kind of event by the mean of their places in three metrics."""
    cents = F.round(F.col("value") * 100).cast("long")
    per = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(cents).alias("total"), F.max(cents).alias("top"))
    ranked = stats.rank_sum(per, "event_type", "user_id", ["n", "total", "top"])
    return ranked.select("event_type", "user_id", F.round("score", 6).alias("score"), "place")


def percent_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference in percent of each status's order total from the total of its priority."""
    cells = _table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    base = cells.groupBy("o_orderpriority").agg(F.sum("cents").alias("all_cents"))
    return cells.join(base, "o_orderpriority").select("o_orderpriority", "o_orderstatus", F.round(stats.percent(F.col("cents"), F.col("all_cents")), 6).alias("pct"))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    orders = _table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    side = lambda y: orders.where(year == y).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))
    return stats.budget_gate(side(1997), side(1998), ["o_orderpriority", "o_orderstatus"], {"orders": (0.5, 3), "cents": (1, 4)})


def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of orders compared under budgets of change."""
    return _gate(spark, sf_dir).select("o_orderpriority", "o_orderstatus", "metric", F.round("pct", 6).alias("pct"), "status")


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over all comparisons; none at all is a failure."""
    return stats.gate_verdict(_gate(spark, sf_dir))


def top_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest changes that fail their budget."""
    keys = ["o_orderpriority", "o_orderstatus", "metric"]
    failed = _gate(spark, sf_dir).where("status = 'FAIL'").select(*keys, F.round("pct", 6).alias("pct"))
    return failed.orderBy(F.abs("pct").desc(), *keys).limit(5)


def cheapest_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of part: sum of its brands' mean sizes, and the brand of the least mean price."""
    brands = _table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("p_retailprice") * 100).cast("long")) / F.count("*")).alias("mean"))
    best = F.min_by("p_brand", F.struct("mean", "p_brand"))
    return brands.groupBy("p_type").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("mean"), 4).alias("sum_of_means"), best.alias("cheapest"))


def stability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all return flags of a line status vary little around a positive median."""
    made = stats.summary(_table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"], "l_quantity")
    return made.groupBy("l_linestatus").agg(F.bool_and((F.col("cv") <= 0.15) & (F.col("median") > 0)).alias("passed"), F.round(F.max("cv"), 8).alias("worst_cv"))


def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that start within 60 seconds of the same user's previous one."""
    ranges = _events(spark, sf_dir).select("user_id", "event_id", F.expr("unix_micros(cast(cast(ts AS string) || 'Z' AS timestamp))").alias("start"), F.lit(60_000_000).cast("long").alias("size"))
    return checks.overlaps(ranges, ["user_id"], "start", "size", "event_id").select("user_id", "event_id", "start", "end_before")


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers are not 1 to n, each once."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    return checks.order_gaps(lines, ["l_orderkey"], "line")


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines found more than once."""
    return checks.repeated(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def trusted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order and without a failed one."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return checks.trusted(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, orders.where("o_orderstatus = 'F'"), "c_custkey")


def replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's value exceeds all earlier ones of its user."""
    seen = _events(spark, sf_dir).select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("seq"))
    return checks.replay_guard(seen, ["user_id"], "event_id", "seq").select("user_id", "event_id", "accepted")


def bad_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from part to supplier numbers that break a rule, with the suppliers as nodes."""
    edges = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return checks.bad_endpoints(edges, _table(spark, sf_dir, "supplier"), "l_partkey", "l_suppkey", "s_suppkey")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each document as the next version of the one before it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    return docs.withColumn("doc_id", F.col("doc_id") + 1), docs


def fixed_chunk_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4096-byte slices in which a document differs from the one before it."""
    changes = chunks.delta(*_versions(spark, sf_dir), "doc_id")
    return changes.select("doc_id", F.col("chunk"), F.md5("old").alias("old"), F.md5("new").alias("new"))


def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each document rebuilt from the one before it and the delta between them."""
    base, target = _versions(spark, sf_dir)
    made = chunks.patched(base, chunks.delta(base, target, "doc_id"), "doc_id")
    return target.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("sha256"))


def payload_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 and size of each payload."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def payload_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IEEE CRC32 of each payload."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.crc32("text").alias("crc32"))


def payload_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document starts when the texts of its source are laid end to end."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return running(docs, ["source"], ["doc_id"], sums=["size"]).select("source", "doc_id", "position", F.col("before_size").alias("start"), "size")


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one kind of each user as one run."""
    return chunks.runs(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


def front_coded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front coding of the part names."""
    return chunks.front_coded(_table(spark, sf_dir, "part"), "p_name")


def key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of the JSON documents, with how many hold each."""
    return _events(spark, sf_dir).select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits and printable ASCII of each text, and whether it looks like real text by their ratios."""
    text = F.coalesce("text", F.lit(""))
    count = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]", "")).cast("long")
    made = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n"), count("0-9").alias("digits"), count(" -~").alias("printable"))
    return made.withColumn("credible", (F.col("n") > 50) & (F.col("printable") * 10 >= F.col("n") * 7) & (F.col("digits") * 2 < F.col("n")))


def copy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy and literal ops that make each document from the one before it."""
    ops = chunks.copy_ops(*_versions(spark, sf_dir), "doc_id")
    return ops.join(_versions(spark, sf_dir)[1].select("doc_id"), "doc_id", "left_semi").select("doc_id", "op", "kind", "from", "size", F.md5("data").alias("data_md5"))


def copy_delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each document replayed from the one before it by its ops."""
    base, target = _versions(spark, sf_dir)
    made = chunks.replayed(base, chunks.copy_ops(base, target, "doc_id"), "doc_id")
    return target.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("sha256"))


def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of each JSON document as a row."""
    return _events(spark, sf_dir).select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def stream_replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay guard over events as a stream."""
    folder = f"{shared_folder(spark)}/guard-{uuid.uuid4().hex}"
    events = spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")
    seen = events.select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("seq"))
    guard_stream(seen, "user_id", "event_id", "seq", folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("user_id", "event_id", "accepted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "group_summary": group_summary,
    "median_by_group": median_by_group,
    "path_lookup": path_lookup,
    "position_index": position_index,
    "metric_summary": metric_summary,
    "ceil_rank_percentiles": ceil_rank_percentiles,
    "outlier_trim": outlier_trim,
    "rank_sum": rank_sum,
    "percent_of_group": percent_of_group,
    "budget_gate": budget_gate,
    "gate_verdict": gate_verdict,
    "top_regressions": top_regressions,
    "cheapest_brand": cheapest_brand,
    "stability_gate": stability_gate,
    "range_overlaps": range_overlaps,
    "order_gaps": order_gaps,
    "repeated_keys": repeated_keys,
    "trusted_customers": trusted_customers,
    "replay_guard": replay_guard,
    "bad_endpoints": bad_endpoints,
    "fixed_chunk_delta": fixed_chunk_delta,
    "delta_round_trip": delta_round_trip,
    "payload_fingerprint": payload_fingerprint,
    "payload_crc32": payload_crc32,
    "payload_offsets": payload_offsets,
    "merged_runs": merged_runs,
    "front_coded_names": front_coded_names,
    "key_dictionary": key_dictionary,
    "byte_classes": byte_classes,
    "copy_delta": copy_delta,
    "copy_delta_round_trip": copy_delta_round_trip,
    "document_fields": document_fields,
    "stream_replay_guard": stream_replay_guard,
}
_GATE_SQL = """o AS (SELECT year(o_orderdate) AS y, o_orderpriority, o_orderstatus, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1, 2, 3),
m AS (SELECT y, o_orderpriority, o_orderstatus, 'orders' AS metric, CAST(orders AS DOUBLE) AS v, 0.5 AS warn, 3 AS fail FROM o UNION ALL SELECT y, o_orderpriority, o_orderstatus, 'cents', CAST(cents AS DOUBLE), 1, 4 FROM o),
p AS (SELECT c.*, (c.v - b.v) / b.v * 100 AS pct FROM m b JOIN m c ON b.y = 1997 AND c.y = 1998 AND b.o_orderpriority = c.o_orderpriority AND b.o_orderstatus = c.o_orderstatus AND b.metric = c.metric WHERE b.v <> 0),
g AS (SELECT *, CASE WHEN pct >= fail THEN 'FAIL' WHEN pct >= warn THEN 'WARN' ELSE 'PASS' END AS status FROM p)"""
SQL: dict[str, str] = {
    "group_summary": "SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "median_by_group": "WITH m AS (SELECT event_type, median(value) AS mid FROM events GROUP BY 1) SELECT event_type, round(any_value(mid), 6) AS mid, round(median(abs(value - mid)), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY 1",
    "path_lookup": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "position_index": "WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents), e AS (SELECT doc_id, n, unnest(range(0, n, 4096)) AS o FROM d) SELECT doc_id, o AS \"offset\", least(4096, n - o) AS size FROM e",
    "metric_summary": "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, round(median(l_extendedprice), 4) AS median, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 8) AS cv, list_sort(list(l_extendedprice))[1 + CAST(ceil(0.95 * (count(*) - 1)) AS BIGINT)] AS p95 FROM lineitem GROUP BY 1",
    "ceil_rank_percentiles": "WITH g AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, n, v[1 + CAST(ceil(0.5 * (n - 1)) AS BIGINT)] AS p50, v[1 + CAST(ceil(0.95 * (n - 1)) AS BIGINT)] AS p95, v[1 + CAST(ceil(0.99 * (n - 1)) AS BIGINT)] AS p99 FROM g",
    "outlier_trim": "WITH m AS (SELECT event_type, median(value) AS mid FROM events GROUP BY 1), o AS (SELECT event_type, abs(value - mid) AS off FROM events JOIN m USING (event_type) WHERE value IS NOT NULL), d AS (SELECT event_type, median(off) AS mad FROM o GROUP BY 1) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE mad = 0 OR off <= 3 * mad) AS kept, count(*) FILTER (WHERE mad = 0 OR off <= 3 * mad) >= 0.7 * count(*) AS accepted FROM o JOIN d USING (event_type) GROUP BY 1",
    "rank_sum": "WITH p AS (SELECT event_type, user_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS total, max(CAST(round(value * 100) AS BIGINT)) AS top FROM events GROUP BY 1, 2), r AS (SELECT event_type, user_id, (row_number() OVER (PARTITION BY event_type ORDER BY n, user_id) + row_number() OVER (PARTITION BY event_type ORDER BY total, user_id) + row_number() OVER (PARTITION BY event_type ORDER BY top, user_id)) / 3 AS score FROM p) SELECT event_type, user_id, round(score, 6) AS score, row_number() OVER (PARTITION BY event_type ORDER BY score, user_id) AS place FROM r",
    "percent_of_group": "WITH c AS (SELECT o_orderpriority, o_orderstatus, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY 1, 2), b AS (SELECT o_orderpriority, sum(c) AS b FROM c GROUP BY 1) SELECT o_orderpriority, o_orderstatus, round(CASE WHEN b = 0 THEN 0 ELSE CAST(c - b AS DOUBLE) / b * 100 END, 6) AS pct FROM c JOIN b USING (o_orderpriority)",
    "budget_gate": f"WITH {_GATE_SQL} SELECT o_orderpriority, o_orderstatus, metric, round(pct, 6) AS pct, status FROM g",
    "gate_verdict": f"WITH {_GATE_SQL} SELECT count(*) AS comparisons, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARN') AS warned, CASE WHEN count(*) = 0 OR count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g",
    "top_regressions": f"WITH {_GATE_SQL} SELECT o_orderpriority, o_orderstatus, metric, round(pct, 6) AS pct FROM g WHERE status = 'FAIL' ORDER BY abs(round(pct, 6)) DESC, 1, 2, 3 LIMIT 5",
    "cheapest_brand": "WITH b AS (SELECT p_type, p_brand, count(*) AS n, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) AS m FROM part GROUP BY 1, 2) SELECT p_type, CAST(sum(n) AS BIGINT) AS n, round(sum(m), 4) AS sum_of_means, first(p_brand ORDER BY m, p_brand) AS cheapest FROM b GROUP BY 1",
    "stability_gate": "WITH g AS (SELECT l_linestatus, l_returnflag, stddev_pop(l_quantity) / nullif(avg(l_quantity), 0) AS cv, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, bool_and(cv <= 0.15 AND m > 0) AS passed, round(max(cv), 8) AS worst_cv FROM g GROUP BY 1",
    "range_overlaps": "WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS start, lag(epoch_us(ts) + 60000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_before FROM events) SELECT * FROM r WHERE end_before > start",
    "order_gaps": "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber < 1) AS out_of_range, count(*) - count(DISTINCT l_linenumber) AS repeated, greatest(0, max(l_linenumber) - count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber >= 1)) AS missing FROM lineitem GROUP BY 1) SELECT * FROM g WHERE out_of_range > 0 OR repeated > 0 OR missing > 0",
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "trusted_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "replay_guard": "WITH s AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS seq FROM events) SELECT user_id, event_id, coalesce(seq > max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), seq IS NOT NULL) AS accepted FROM s",
    "bad_endpoints": "WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (SELECT *, CASE WHEN l_partkey NOT IN (SELECT s_suppkey FROM supplier) THEN 'no source' WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier) THEN 'no target' WHEN l_partkey = l_suppkey THEN 'self loop' END AS code FROM e) SELECT * FROM c WHERE code IS NOT NULL",
    "fixed_chunk_delta": "WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents), s AS (SELECT doc_id, unnest(range(0, n, 4096)) AS o, hex(b) AS h FROM t), x AS (SELECT doc_id, o // 4096 AS chunk, md5(unhex(substr(h, 2 * o + 1, 8192))) AS m FROM s) SELECT coalesce(a.doc_id + 1, c.doc_id) AS doc_id, coalesce(a.chunk, c.chunk) AS chunk, a.m AS old, c.m AS new FROM x a FULL JOIN x c ON a.doc_id + 1 = c.doc_id AND a.chunk = c.chunk WHERE a.m IS DISTINCT FROM c.m",
    "delta_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "payload_fingerprint": "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents",
    "payload_offsets": "WITH d AS (SELECT source, doc_id, strlen(coalesce(text, '')) AS size FROM documents) SELECT source, doc_id, row_number() OVER w AS position, CAST(sum(size) OVER w - size AS BIGINT) AS start, size FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)",
    "merged_runs": "WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f) SELECT user_id, run, any_value(event_type) AS event_type, min(event_id) AS \"first\", count(*) AS n FROM r GROUP BY 1, 2",
    "front_coded_names": "WITH k AS (SELECT DISTINCT p_name AS key FROM part WHERE p_name IS NOT NULL), l AS (SELECT key, row_number() OVER (ORDER BY key) AS position, lag(key) OVER (ORDER BY key) AS before FROM k), s AS (SELECT key, position, len(list_filter(range(1, 1 + least(length(key), coalesce(length(before), 0))), lambda i: substr(key, 1, i) = substr(before, 1, i))) AS shared FROM l) SELECT position, shared, substr(key, CAST(shared + 1 AS BIGINT)) AS rest FROM s",
    "key_dictionary": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "byte_classes": "WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits, length(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')) AS printable FROM documents) SELECT *, n > 50 AND printable * 10 >= n * 7 AND digits * 2 < n AS credible FROM d",
    "copy_delta": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, o, substr(h, 2 * o + 1, 16384) AS h FROM (SELECT doc_id, h, unnest(range(0, n, 8192)) AS o FROM t)),
b AS (SELECT doc_id + 1 AS doc_id, h, min(o) AS f FROM s GROUP BY 1, 2),
m AS (SELECT s.doc_id, s.o, s.h, length(s.h) // 2 AS z, b.f FROM s LEFT JOIN b ON s.doc_id = b.doc_id AND s.h = b.h),
k AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND CASE WHEN f IS NULL THEN lag(f) OVER w IS NULL ELSE f IS NOT DISTINCT FROM lag(f) OVER w + lag(z) OVER w END THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS op FROM k)
SELECT doc_id, op, CASE WHEN min(f) IS NULL THEN 'LITERAL' ELSE 'COPY' END AS kind, min(f) AS "from", CAST(sum(z) AS BIGINT) AS size, CASE WHEN min(f) IS NULL THEN md5(unhex(string_agg(h, '' ORDER BY o))) END AS data_md5 FROM r GROUP BY 1, 2""",
    "copy_delta_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "document_fields": "SELECT event_id, j.key, json_extract_string(props, '$.' || j.key) AS value FROM events, json_each(props) j",
}
SQL["stream_replay_guard"] = SQL["replay_guard"]

QUERIES |= formats.QUERIES | payloads.QUERIES
SQL |= formats.SQL | payloads.SQL
