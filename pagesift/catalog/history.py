"""Queries on the job history and on keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.catalog import derived
from pagesift.catalog.registry import query, table
from pagesift.operators import jobs

LATEST = """latest AS (
  SELECT user_id AS job_id, ts, event_id, event_type, props, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1)"""

KEYS = "keys AS (SELECT sha256(c_name) AS key_hash, c_name, c_acctbal > 0 AS is_active FROM customer)"
KEY = "'Customer#' || lpad(user_id::VARCHAR, 9, '0')"


@query("job_latest", f"WITH {LATEST} SELECT job_id, ts, event_id AS seq, event_type AS status FROM latest")
def job_latest(spark, folder):
    return jobs.job_latest(derived.job_events(spark, folder)).select("job_id", "ts", "seq", "status")


def _upserted(spark, folder):
    new = derived.job_events(spark, folder).select(
        "job_id", F.lit("pdf").alias("job_type"), "status", F.col("payload").alias("request_json"), "ts", "seq"
    )
    return jobs.upsert_jobs(derived.job_table(spark, folder), new)


UPSERTED = f"""{LATEST}, firsts AS (SELECT user_id AS job_id, min(ts) AS ts FROM events GROUP BY user_id),
old AS (SELECT c_custkey AS job_id, c_name FROM customer), upserted AS (
  SELECT coalesce(event_id + (SELECT max(c_custkey) FROM customer), old.job_id) AS id, coalesce(latest.job_id, old.job_id) AS job_id,
         CASE WHEN event_id IS NULL THEN 'scrape' ELSE 'pdf' END AS job_type,
         coalesce(event_type, 'PENDING') AS status,
         coalesce(props, '{{"url":"' || c_name || '"}}') AS request_json,
         CASE WHEN event_id IS NULL THEN '{{"ok": true}}' END AS result_json, NULL::VARCHAR AS error_text,
         CASE WHEN old.job_id IS NULL THEN firsts.ts ELSE TIMESTAMP '2020-01-01' END AS created_at,
         coalesce(latest.ts, TIMESTAMP '2020-01-01') AS updated_at
  FROM latest JOIN firsts USING (job_id) FULL JOIN old ON old.job_id = latest.job_id)"""


@query("jobs_upsert", f"WITH {UPSERTED} SELECT * FROM upserted")
def jobs_upsert(spark, folder):
    return _upserted(spark, folder)


@query(
    "jobs_update",
    f"""WITH {LATEST} SELECT c_custkey AS id, c_custkey AS job_id, coalesce(event_type, 'PENDING') AS status,
    CASE WHEN event_id IS NULL THEN '{{"ok": true}}' WHEN event_type <> 'error' THEN props END AS result_json,
    CASE WHEN event_type = 'error' THEN props END AS error_text,
    coalesce(ts, TIMESTAMP '2020-01-01') AS updated_at
    FROM customer LEFT JOIN latest ON c_custkey = job_id""",
)
def jobs_update(spark, folder):
    failed = F.col("status") == "error"
    changes = derived.job_events(spark, folder).select(
        "job_id", "status", F.when(~failed, F.col("payload")).alias("result_json"),
        F.when(failed, F.col("payload")).alias("error_text"), "ts", "seq",
    )
    done = jobs.update_jobs(derived.job_table(spark, folder), changes)
    return done.select("id", "job_id", "status", "result_json", "error_text", "updated_at")


@query(
    "recent_jobs",
    f"""WITH {UPSERTED} SELECT id, job_id, status, (request_json->>'$.k')::INTEGER AS k, created_at
    FROM upserted ORDER BY id DESC, job_id LIMIT 50""",
)
def recent_jobs(spark, folder):
    """The limit is the feature: the newest 50 jobs of the whole table."""
    newest = jobs.recent_jobs(_upserted(spark, folder))
    k = F.try_variant_get("request", "$.k", "int")
    return newest.select("id", "job_id", "status", k.alias("k"), "created_at")


@query(
    "authorised_events",
    f"""WITH {KEYS} SELECT event_id, ts, {KEY} AS api_key FROM events
    WHERE sha256({KEY}) IN (SELECT key_hash FROM keys WHERE is_active)""",
)
def authorised_events(spark, folder):
    return jobs.active_only(derived.key_uses(spark, folder), derived.api_keys(spark, folder))


@query(
    "key_last_used",
    f"""WITH {KEYS} SELECT key_hash, max(ts) AS last_used_at FROM events JOIN keys ON sha256({KEY}) = key_hash
    WHERE is_active GROUP BY key_hash""",
)
def key_last_used(spark, folder):
    return jobs.key_last_used(derived.key_uses(spark, folder), derived.api_keys(spark, folder))


@query(
    "active_key_count",
    f"WITH {KEYS} SELECT count_if(is_active)::BIGINT AS n, count_if(is_active) > 0 AS has_keys FROM keys",
)
def active_key_count(spark, folder):
    return jobs.active_key_count(derived.api_keys(spark, folder))


@query(
    "insert_if_absent",
    f"""WITH {KEYS} SELECT key_hash, c_name AS name, is_active FROM keys
    UNION ALL SELECT sha256(s_name), s_name, true FROM supplier
    UNION ALL SELECT sha256(name), name, true FROM (SELECT DISTINCT {KEY} AS name FROM events
      WHERE {KEY} NOT IN (SELECT c_name FROM customer))""",
)
def insert_if_absent(spark, folder):
    """Keys of suppliers are new; those of customers, taken from their uses, are mostly there."""
    used = derived.key_uses(spark, folder).select(F.col("api_key").alias("name"))
    names = used.unionByName(table(spark, folder, "supplier").select(F.col("s_name").alias("name")))
    rows = names.select(
        F.sha2(F.col("name").cast("binary"), 256).alias("key_hash"), "name", F.lit(True).alias("is_active")
    )
    return jobs.insert_if_absent(derived.api_keys(spark, folder), rows, "key_hash")
