"""Queries over the training-data tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, decontamination, html_extract, jaccard_join, quality, suffix_dedup, surrogates, token_counts, toxicity, url_filter
from granary.llm.common import table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> list[tuple[str, float]]:
    import public_tokenizers

    return token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


#: The key of the surrogates; a deployment passes its own.
KEY = "change me"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.apply(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", byte_bpe(), keep_ids=False)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep=False).drop("kept")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tree_marginals": op1,
    "op2_benchmark_containment": op2,
    "op3_compression_bands": op3,
    "op4_factorization_machine": op4,
    "op5_viterbi_counts": op5,
    "op6_url_filter": op6,
    "op7_chunked_bpe": op7,
    "op8_suffix_dedup": op8,
    "op9_jaccard_join": op9,
    "op10_surrogates": op10,
}

_RULE_ROWS = ", ".join(f"('{k}', '{a}')" for k, a in RULES)
SQL: dict[str, str] = {
    "op2_benchmark_containment": r"""
WITH w AS (SELECT 1 AS side, item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark
  UNION ALL SELECT 0, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') FROM documents),
k AS (SELECT side, id, w, CASE WHEN side = 1 THEN least(len(w), 5) ELSE 0 END AS k FROM w WHERE len(w) > 0),
s AS (SELECT side, id, w, kk AS k, unnest(range(1, len(w) - kk + 2)) AS i FROM (SELECT side, id, w, k AS kk FROM k WHERE side = 1 UNION ALL SELECT d.side, d.id, d.w, z.k FROM k d, (SELECT DISTINCT k FROM k WHERE side = 1) z WHERE d.side = 0)),
g AS (SELECT DISTINCT side, id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM s),
n AS (SELECT id, count(*) AS n FROM g WHERE side = 1 GROUP BY id),
x AS (SELECT d.id AS doc_id, t.id AS item_id, count(*) AS shared FROM g d JOIN g t ON d.side = 0 AND t.side = 1 AND d.k = t.k AND d.g = t.g GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, shared FROM x JOIN n ON n.id = x.item_id WHERE shared * 100 >= n * 75""",
    "op6_url_filter": f"""
WITH rules(rule, action) AS (VALUES {_RULE_ROWS}),
r AS (SELECT rule, action, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
u AS (SELECT n, page_id, lower(regexp_extract(x, '^[^/?#]*')) AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT n, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (n)""",
}
