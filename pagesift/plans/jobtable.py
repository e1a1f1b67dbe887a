"""A job table that a feed keeps current: hashed into buckets, written anew bucket by bucket.

``root/bucket=k/slot=s`` holds a bucket twice at most. The slot with the higher batch number
counts. A batch reads the buckets that its changes fall into and writes each into its other
slot, which replaces the version before the last. A batch that is tried again finds its own
half-done versions, passes over them and writes them again, so it counts once. Nothing grows
but the table, and nothing has to be compacted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "job_id": T.LongType(),
    "job_type": T.StringType(),
    "status": T.StringType(),
    "request_json": T.StringType(),
    "result_json": T.StringType(),
    "error_text": T.StringType(),
    "created_at": T.TimestampNTZType(),
    "updated_at": T.TimestampNTZType(),
    "seq": T.LongType(),
}
JOBS = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])
_VERSION = {"batch": T.LongType(), "bucket": T.IntegerType(), "slot": T.IntegerType()}
_STORED = T.StructType([*JOBS.fields, *[T.StructField(name, kind) for name, kind in _VERSION.items()]])
#: Buckets of a table. A batch rewrites those it touches, so a bucket should be a few files' worth.
BUCKETS = 64


def bucket_of(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def create_job_table(spark: SparkSession, root: str) -> str:
    """An empty table; does nothing to one that is there."""
    empty = spark.createDataFrame([], _STORED)
    empty.write.mode("append").partitionBy("bucket", "slot").parquet(root)
    return root


def _stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(root)


def _current_slots(stored: DataFrame, before: int | None) -> dict[int, int]:
    """The slot of each bucket that counts, of versions of earlier batches than ``before``. One
    column is read; there are at most two versions of a bucket."""
    versions = stored.groupBy("bucket", "slot").agg(F.max("batch").alias("batch"))
    if before is not None:
        versions = versions.filter(F.col("batch") < before)
    rows = versions.groupBy("bucket").agg(F.max_by("slot", "batch").alias("slot")).collect()
    return {row["bucket"]: row["slot"] for row in rows}


def _of_slots(stored: DataFrame, slots: dict[int, int]) -> DataFrame:
    """The rows of one slot of each bucket; Spark reads no other folder."""
    chosen = F.lit(False)
    for slot in (0, 1):
        if buckets := sorted(b for b, s in slots.items() if s == slot):
            chosen = chosen | ((F.col("slot") == slot) & F.col("bucket").isin(buckets))
    return stored.filter(chosen)


def read_job_table(spark: SparkSession, root: str) -> DataFrame:
    """The current row of every job."""
    stored = _stored(spark, root)
    return _of_slots(stored, _current_slots(stored, None)).select(*JOBS.names)


def merged_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` after ``changes`` (job_id, kind, job_type, status, request_json, result_json,
    error_text, ts, seq), which are taken in the order of ``ts`` and ``seq``.

    An ``insert`` replaces a job but for ``created_at`` and clears result and error. An ``update``
    sets status, result, error and time, of known jobs only. Changes that are not newer than
    the row they meet are late and change nothing. Changes are reduced to one row for each
    job, with partial aggregation, before they meet the table.
    """
    def moment(ts: Column, seq: Column) -> Column:
        return F.struct(ts.alias("ts"), seq.alias("seq"))

    def newest(kind: str, *fields: str) -> Column:
        order = F.when(F.col("kind") == kind, moment(F.col("ts"), F.col("seq")))
        return F.max_by(F.struct("ts", "seq", *fields), order)

    news = changes.groupBy("job_id").agg(
        newest("insert", "job_type", "status", "request_json").alias("new"),
        newest("update", "status", "result_json", "error_text").alias("done"),
        F.min(F.when(F.col("kind") == "insert", F.col("ts"))).alias("first"),
    )
    known = jobs.select("job_id", F.struct(*[c for c in JOBS.names if c != "job_id"]).alias("old"))
    both = known.join(news, "job_id", "full_outer")
    old, last = F.col("old"), moment(F.col("old.updated_at"), F.col("old.seq"))
    for name in ("new", "done"):
        late = old.isNotNull() & (moment(F.col(f"{name}.ts"), F.col(f"{name}.seq")) <= last)
        both = both.withColumn(name, F.when(~late, F.col(name)))
    new, done = F.col("new"), F.col("done")
    both = both.filter(old.isNotNull() | new.isNotNull())
    after = moment(F.col("done.ts"), F.col("done.seq")) > moment(F.col("new.ts"), F.col("new.seq"))
    is_done = done.isNotNull() & (new.isNull() | after)

    def pick(inserted: Column, kept: str, updated: Column | None = None) -> Column:
        value = F.when(new.isNotNull(), inserted).otherwise(F.col(f"old.{kept}"))
        return (value if updated is None else F.when(is_done, updated).otherwise(value)).alias(kept)

    return both.select(
        "job_id",
        pick(F.col("new.job_type"), "job_type"),
        pick(F.col("new.status"), "status", F.col("done.status")),
        pick(F.col("new.request_json"), "request_json"),
        pick(F.lit(None).cast("string"), "result_json", F.col("done.result_json")),
        pick(F.lit(None).cast("string"), "error_text", F.col("done.error_text")),
        F.coalesce("old.created_at", "first").alias("created_at"),
        pick(F.col("new.ts"), "updated_at", F.col("done.ts")),
        pick(F.col("new.seq"), "seq", F.col("done.seq")),
    )


def apply_changes(root: str, changes: DataFrame, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Bring the table up to date with a batch of changes and return the buckets written anew.

    Batches come with ascending numbers from 0, as those of a feed do; the last one may come
    again. Changes without ``job_id`` are left out.
    """
    spark = changes.sparkSession
    changes = changes.filter("job_id is not null").withColumn("bucket", bucket_of(F.col("job_id"), buckets))
    touched = sorted(row["bucket"] for row in changes.select("bucket").distinct().collect())
    if not touched:
        return []
    stored = _stored(spark, root).filter(F.col("bucket").isin(touched))
    slots = _current_slots(stored, before=batch)
    jobs = merged_jobs(_of_slots(stored, slots).select(*JOBS.names), changes.drop("bucket"))
    bucket = bucket_of(F.col("job_id"), buckets)
    in_one = F.array(*[F.lit(b) for b, slot in sorted(slots.items()) if slot == 0]).cast("array<int>")
    rows = jobs.select(*JOBS.names, F.lit(batch).cast("long").alias("batch"), bucket.alias("bucket"))
    rows = rows.withColumn("slot", F.when(F.array_contains(in_one, F.col("bucket")), 1).otherwise(0))
    writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket", "slot").parquet(root)
    return touched
