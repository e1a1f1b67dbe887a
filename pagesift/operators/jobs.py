"""Job history and keys, as operations on tables.

Job ids are unique in a job table. Changes may repeat an id: they are reduced to one
row per id, with partial aggregation before the shuffle, ahead of any join, so a job
with very many changes never meets the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import hash_key
from pagesift.plans.skew import split_hot_keys_join


def job_latest(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last row per key by ``order``."""
    rest = [c for c in events.columns if c != key]
    latest = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return latest.select(key, "row.*")


def upsert_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by ``job_id``.

    ``new`` has job_id, job_type, status, request_json, ts and seq. A replaced job keeps
    its ``created_at``, loses result and error, and gets a new ``id``: the ``seq`` of the
    change above the largest id of ``jobs``, so that it sorts after all of them without any
    global numbering.
    """
    newest = F.max_by(F.struct("seq", "job_type", "status", "request_json", "ts"), F.struct("ts", "seq"))
    changes = new.groupBy("job_id").agg(newest.alias("new"), F.min("ts").alias("first_ts"))
    old = jobs.select("job_id", F.struct(*[c for c in jobs.columns if c != "job_id"]).alias("old"))
    both = old.join(changes, "job_id", "full_outer")
    replaced = F.col("new").isNotNull()
    largest = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()

    def pick(new_value: Column, name: str) -> Column:
        return F.when(replaced, new_value).otherwise(F.col(f"old.{name}")).alias(name)

    return both.select(
        pick(largest + F.col("new.seq"), "id"),
        "job_id",
        pick(F.col("new.job_type"), "job_type"),
        pick(F.col("new.status"), "status"),
        pick(F.col("new.request_json"), "request_json"),
        pick(F.lit(None), "result_json"),
        pick(F.lit(None), "error_text"),
        F.coalesce("old.created_at", "first_ts").alias("created_at"),
        pick(F.col("new.ts"), "updated_at"),
    )


def update_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Set status, result, error and time by ``job_id``; an unknown id changes nothing.

    ``changes`` has job_id, status, result_json, error_text, ts and seq.
    """
    last = job_latest(changes).select(
        "job_id", F.struct("status", "result_json", "error_text", "ts").alias("new")
    )
    changed = F.col("new").isNotNull()

    def pick(new_name: str, name: str) -> Column:
        return F.when(changed, F.col(f"new.{new_name}")).otherwise(F.col(name)).alias(name)

    renamed = {"status": "status", "result_json": "result_json", "error_text": "error_text", "updated_at": "ts"}
    return jobs.join(last, "job_id", "left").select(
        *[pick(renamed[c], c) if c in renamed else F.col(c) for c in jobs.columns]
    )


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs first, their JSON readable as variants."""
    decoded = [
        F.try_parse_json("request_json").alias("request"),
        F.try_parse_json("result_json").alias("result"),
        F.col("error_text").alias("error"),
    ]
    newest = jobs.orderBy(F.desc("id"), "job_id").limit(limit)
    return newest.select("id", "job_id", "job_type", "status", *decoded, "created_at", "updated_at")


def active_only(
    df: DataFrame, keys: DataFrame, key: str = "api_key", splits: int | None = None
) -> DataFrame:
    """Rows whose key matches an active one. ``keys`` has key_hash and is_active.

    ``df`` is read once. Keys are few as a rule and then go to the rows; if they are many,
    adaptive execution splits a key with very many uses, or ``splits`` deals it out
    beforehand, which reads ``df`` twice.
    """
    active = keys.filter("is_active").select("key_hash")
    hashed = df.withColumn("key_hash", hash_key(F.col(key)))
    if splits is None:
        return hashed.join(active, "key_hash", "left_semi").drop("key_hash")
    return split_hot_keys_join(hashed, active, "key_hash", "left_semi", splits).drop("key_hash")


def key_last_used(df: DataFrame, keys: DataFrame, key: str = "api_key", ts: str = "ts") -> DataFrame:
    """Active keys that were used, and when last: key_hash, last_used_at.

    Uses are reduced to one row per key before they are hashed and joined.
    """
    last = df.groupBy(key).agg(F.max(ts).alias("last_used_at"))
    hashed = last.select(hash_key(F.col(key)).alias("key_hash"), "last_used_at")
    return hashed.join(keys.filter("is_active").select("key_hash"), "key_hash", "left_semi")


def active_key_count(keys: DataFrame) -> DataFrame:
    """One row: n, and whether there is any."""
    counted = keys.agg(F.count_if("is_active").alias("n"))
    return counted.withColumn("has_keys", F.col("n") > 0)


def insert_if_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``df`` and those of ``rows`` whose key it lacks. Of rows with the same key the
    smallest goes in, so that a repeated run inserts the same one."""
    rest = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")
    return df.unionByName(once.join(df.select(key), key, "left_anti"))
