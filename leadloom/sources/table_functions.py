"""The two table functions of the storage, as SQL functions over views of its tables.

    SELECT * FROM new_finance_signals('[{"dedupe_key": ..., ...}]')
    SELECT * FROM intake_sample_request(name, email, niche, city, cadence, notes)

They read what is stored and return what a commit would write; writing is finance.persist and upsert.bump_into."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Who owns a request, and the fields of a signal.
OWNER = "sakuya"
SIGNAL = "ARRAY<STRUCT<dedupe_key: STRING, account_id: STRING, entity_id: STRING, signal_key: STRING, signal_type: STRING, event_type: STRING, event_date: DATE>>"


def register(spark: SparkSession, claims: str = "finance_event_dedupe", requests: str = "sample_intake_requests") -> None:
    """claims: a view with dedupe_key; requests: a view with dedupe_key, receipt_id, status, sla_due_at."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION new_finance_signals(signal_rows STRING)
        RETURNS TABLE (signal_key STRING, entity_id STRING, signal_type STRING, event_type STRING, event_date DATE, dedupe_key STRING, input_rows BIGINT)
        RETURN WITH given AS (SELECT pos, row.* FROM (SELECT posexplode(from_json(signal_rows, '{SIGNAL}')) AS (pos, row))),
          firsts AS (SELECT dedupe_key AS k, min_by(struct(signal_key, entity_id, signal_type, event_type, event_date), pos) AS f, count(*) AS n FROM given GROUP BY dedupe_key)
        SELECT f.signal_key, f.entity_id, f.signal_type, f.event_type, f.event_date, k, n FROM firsts LEFT ANTI JOIN {claims} AS c ON c.dedupe_key = firsts.k""")
    form = "btrim(regexp_replace(coalesce({x}, ''), '(?U)\\\\s+', ' '))"
    cadence = f"coalesce(nullif({form.format(x='p_cadence')}, ''), 'weekly')"
    fields = [*[form.format(x=x) for x in ("p_name", "p_email", "p_niche", "p_city")], cadence, form.format(x="p_notes")]
    key = f"concat('sha256:', sha2(to_json(array({', '.join(f'lower({f})' for f in fields)})), 256))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION intake_sample_request(p_name STRING, p_email STRING, p_niche STRING, p_city STRING, p_cadence STRING, p_notes STRING, p_at TIMESTAMP)
        RETURNS TABLE (dedupe_key STRING, receipt_id STRING, status STRING, owner STRING, sla_due_at TIMESTAMP, duplicate BOOLEAN)
        RETURN SELECT k, coalesce(r.receipt_id, concat('receipt-', left(sha2(k, 256), 36))), coalesce(r.status, 'queued'), '{OWNER}', coalesce(r.sla_due_at, p_at + INTERVAL 1 DAY), r.dedupe_key IS NOT NULL
        FROM (SELECT {key} AS k) LEFT JOIN {requests} AS r ON r.dedupe_key = k""")
