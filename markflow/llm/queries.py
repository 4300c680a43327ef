"""Queries of the training-data operators: opN_<name>, and pipeline; with DuckDB SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, exact_dedup, katz, licenses, mixing, quality, sentencepiece, simhash, suffix_dedup, url_filter
from .common import table

SQL: dict[str, str] = {}


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup_table(table(spark, sf_dir, "documents"))


def op2_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


SQL["op3_license_scan"] = f"""
WITH t AS (SELECT license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w
           FROM (VALUES {', '.join("('" + n.replace("'", "''") + "', '" + x.replace("'", "''") + "')" for n, x in licenses.TEMPLATES)}) v(license, text)),
tb AS (SELECT license, len(w) - 1 AS b, unnest(list_zip(w[:-2], w[2:])) AS g FROM t),
tc AS (SELECT license, b, g, count(*) AS n FROM tb GROUP BY ALL),
l AS (SELECT doc_id, generate_subscripts(u, 1) - 1 AS line, unnest(u) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents)
      UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, line, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM l),
p AS (SELECT doc_id, line, len(w) - 1 AS a, unnest(list_zip(w[:-2], w[2:])) AS g FROM w WHERE len(w) BETWEEN 2 AND 400),
m AS (SELECT doc_id, line, a, license, b, n, count(*) AS m FROM p JOIN tc USING (g) GROUP BY doc_id, line, a, license, b, g, n),
d AS (SELECT doc_id, line, license, 2 * sum(least(m, n)) / (a + b) AS dice FROM m GROUP BY doc_id, line, a, license, b),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, line) AS r,
             count(DISTINCT CASE WHEN line >= 0 THEN line END) OVER (PARTITION BY doc_id) AS n_lines FROM d WHERE dice >= 0.8)
SELECT doc_id, license, dice, CAST(line AS INTEGER) AS line, n_lines FROM k WHERE r = 1
"""


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 100 = 0"))


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as captures on dates dealt by page_id, and a dated list made from their hosts: of every third host (by MD5) the
    host goes on the list, later off it, and for some on again; domains of two labels likewise of every eleventh host."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 365 as int))").alias("fetched_at"))
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("v", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    day = lambda e: F.expr(f"date_add(date'2024-01-01', {e})")
    domain = F.substring_index("host", ".", -3)
    log = lambda e, at, active: F.struct(e.alias("entry"), day(at).alias("at"), F.expr(active).alias("active"))
    own = F.col("host")
    three = F.array(log(own, "v % 200", "v >= 0"), log(own, "v % 200 + 30 + v % 50", "v < 0"), log(own, "v % 200 + 100 + v % 60", "v % 2 = 0"))
    one = F.array(log(domain, "v % 300", "v % 4 <> 0"))
    events = hosts.where("v % 3 = 0").select(F.inline(three)).unionAll(hosts.where("v % 11 = 0").select(F.inline(one)))
    return captures, events


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, events = _captures(spark, sf_dir)
    rows = url_filter.as_of(captures, events)
    return rows.select("page_id", "host", F.col("fetched_at").cast("string").alias("fetched_at"), "blocked", "entry", F.col("since").cast("string").alias("since"))


SQL["op5_url_filter"] = f"""
WITH c AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched_at,
                  coalesce(regexp_extract(lower(url), '{url_filter.HOST}', 1), '') AS host FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS v FROM c WHERE host <> ''),
e AS (SELECT host AS entry, DATE '2024-01-01' + v % 200 AS day, true AS active FROM h WHERE v % 3 = 0
      UNION ALL SELECT host, DATE '2024-01-01' + (v % 200 + 30 + v % 50), false FROM h WHERE v % 3 = 0
      UNION ALL SELECT host, DATE '2024-01-01' + (v % 200 + 100 + v % 60), v % 2 = 0 FROM h WHERE v % 3 = 0
      UNION ALL SELECT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.'), DATE '2024-01-01' + v % 300, v % 4 <> 0 FROM h WHERE v % 11 = 0),
o AS (SELECT entry, day, bool_or(active) AS active FROM e GROUP BY ALL),
i AS (SELECT entry, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until, active FROM o),
m AS (SELECT c.page_id, i.entry, i.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.entry) DESC) AS r
      FROM c JOIN i ON i.active AND (c.host = i.entry OR ends_with(c.host, '.' || i.entry)) AND c.fetched_at >= i.since AND (i.until IS NULL OR c.fetched_at < i.until))
SELECT c.page_id, c.host, CAST(c.fetched_at AS VARCHAR) AS fetched_at, m.entry IS NOT NULL AS blocked, m.entry, CAST(CAST(m.since AS DATE) AS VARCHAR) AS since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)
    return rows.select("doc_id", "p_text", "host_posterior", "path_posterior", "score", "keep")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.dedup_table(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_table(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


#: The model file; a parameter of the operator.
PIECES = os.environ.get("MARKFLOW_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return rows.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_table(table(spark, sf_dir, "documents")).drop("kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline} | {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
