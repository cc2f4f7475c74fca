"""Synthetic records over the given tables: business leads, job posts, forum posts.

The texts are SQL that Spark and DuckDB both run, so queries and twins start alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Moment of evaluation for ages.
NOW = "2024-01-31 00:00:00"

LEADS = """
SELECT c.c_custkey AS ord, c.c_custkey AS id, n.n_nationkey AS run_id,
  CASE WHEN c.c_custkey % 11 = 0 THEN '' ELSE concat('  Shop   ', CAST(c.c_custkey % 300 AS STRING), ' ') END AS raw_name,
  CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE concat('https://www.shop', CAST(c.c_custkey % 300 AS STRING), '.example.com/about') END AS raw_website,
  CASE WHEN c.c_custkey % 4 = 0 THEN '' WHEN c.c_custkey % 4 = 1 THEN concat('(512) 555-', lpad(CAST(c.c_custkey % 300 AS STRING), 4, '0')) WHEN c.c_custkey % 4 = 2 THEN concat('1-512-556-', lpad(CAST(c.c_custkey % 300 AS STRING), 4, '0')) ELSE concat('+44 20 ', lpad(CAST(c.c_custkey % 300 AS STRING), 6, '0')) END AS raw_phone,
  CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE concat(' Info', CAST(c.c_custkey % 300 AS STRING), '@Example.COM ') END AS raw_email,
  n.n_name AS city, c.c_mktsegment AS niche,
  CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE concat('https://list.example.org/', CAST(c.c_custkey AS STRING)) END AS source_url,
  '2024-01-30T00:00:00Z' AS collected_at, '' AS title,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'Now HIRING and opening a new location' ELSE 'family business' END AS description, CASE WHEN c.c_custkey % 19 = 0 THEN 'growth, campaign' ELSE '' END AS keywords, CASE WHEN c.c_custkey % 29 = 0 THEN 'may request a quote' ELSE '' END AS notes,
  CASE WHEN c.c_custkey % 2 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS source_confidence,
  CASE WHEN c.c_custkey % 3 = 1 THEN CAST(0.8 AS DOUBLE) END AS extraction_confidence,
  CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE CAST((c.c_custkey % 6) * 20 AS DOUBLE) END AS freshness_hours,
  c.c_custkey % 3 = 0 AS hiring_intent, c.c_custkey % 4 = 0 AS recent_activity, c.c_custkey % 5 = 0 AS review_velocity, c.c_custkey % 6 = 0 AS pricing_signal, c.c_custkey % 7 = 0 AS social_proof_signal, c.c_custkey % 8 = 0 AS trigger_event,
  CAST(c.c_custkey % 50 AS DOUBLE) AS reviews_count, abs(c.c_acctbal) / CAST(2000 AS DOUBLE) AS rating, CAST(c.c_custkey % 9 AS DOUBLE) AS employee_count,
  c.c_custkey % 17 = 0 AS previous_response, CAST(0 AS DOUBLE) AS reply_count, false AS engagement_signal,
  'BUILDING' AS context_niche, CASE WHEN c.c_custkey % 2 = 0 THEN 'CHINA' ELSE '' END AS context_city
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

JOBS = """
SELECT doc_id AS ord, substr(text, 1, 40) AS job_title, concat('Company ', CAST(doc_id % 40 AS STRING)) AS company_name,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('https://jobs.example.com/', CAST(doc_id AS STRING)) END AS posting_url,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS location, CASE WHEN doc_id % 9 = 0 THEN concat(substr(text, 1, 1900), ' senior remote training') ELSE substr(text, 1, 2000) END AS raw_snippet,
  CASE WHEN doc_id % 2 = 0 THEN 'linkedin' ELSE 'indeed' END AS source, substr(text, 3, 4) AS keyword,
  CASE WHEN doc_id % 5 = 0 THEN 'https://c.example.com' ELSE '' END AS company_url,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST((doc_id % 6) * 40 AS DOUBLE) END AS age_hours
FROM {documents}
"""

POSTS = """
SELECT doc_id AS ord, substr(text, 1, 30) AS job_title, CASE WHEN doc_id % 7 = 0 THEN concat(substr(text, 1, 1500), ' looking for a vendor, pricing is terrible; hiring') ELSE substr(text, 1, 2000) END AS raw_snippet,
  CASE WHEN doc_id % 7 = 0 THEN concat(text, ' looking for a vendor, pricing is terrible; hiring') ELSE text END AS body,
  concat('user', CAST(doc_id % 60 AS STRING)) AS company_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('https://forum.example.com/', CAST(doc_id % 500 AS STRING)) END AS posting_url,
  CASE WHEN doc_id % 2 = 0 THEN 'instructionaldesign' ELSE 'elearning' END AS subreddit, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 500 AS STRING) END AS post_id,
  doc_id % 23 AS upvotes, doc_id % 13 AS comment_count, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS upvote_ratio,
  CAST((doc_id % 8) * 30 AS DOUBLE) AS age_hours
FROM {documents}
"""


#: Tables of short rows that long records are made of.
_SHORT = {"customer": "c_custkey"}


def dealt(table: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """The table with some `rows` of it to a task. Short rows compress to little, so a split of a file may hold millions of
    them, and one task would make, score and sort all their records."""
    tasks = table.count() // rows + 1
    return table if tasks == 1 else table.repartition(tasks, key)


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql, **{t: dealt(df, _SHORT[t]) if t in _SHORT else df for t, df in read.items()})


def duck(sql: str) -> str:
    """The same text over DuckDB's views."""
    for name in ("customer", "nation", "documents"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("regexp_like(", "regexp_matches(")
