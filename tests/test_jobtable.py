"""The bucketed job table: against a plain fold, repeated batches, what a batch rewrites."""

import datetime
import random
from pathlib import Path

from pyspark.sql import functions as F

from pagesift.plans.jobtable import JOBS, apply_changes, bucket_of, create_job_table, merged_jobs, read_job_table

CHANGES = (
    "job_id bigint, kind string, job_type string, status string, request_json string, result_json string, "
    "error_text string, ts timestamp_ntz, seq bigint"
)
START = datetime.datetime(2024, 5, 6)


def change(rng, seq):
    kind = rng.choice(["insert", "update", "update", "odd"])
    moment = START + datetime.timedelta(minutes=seq // 2)
    return (rng.choice([*range(12), None]), kind, f"t{seq}", f"s{seq}", f"q{seq}", rng.choice([None, f"r{seq}"]), rng.choice([None, f"e{seq}"]), moment, seq)


def folded(changes):
    """One change after the other."""
    jobs = {}
    for job, kind, job_type, status, request, result, error, ts, seq in sorted(changes, key=lambda c: (c[7], c[8])):
        if job is None:
            continue
        if kind == "insert":
            created = jobs[job][5] if job in jobs else ts
            jobs[job] = [job_type, status, request, None, None, created, ts, seq]
        elif kind == "update" and job in jobs:
            jobs[job] = [jobs[job][0], status, jobs[job][2], result, error, jobs[job][5], ts, seq]
    return sorted((job, *row) for job, row in jobs.items())


def current(spark, root):
    return sorted(tuple(r) for r in read_job_table(spark, root).collect())


def test_batches_equal_a_plain_fold_and_count_once(spark, tmp_path):
    rng = random.Random(4)
    root, done = create_job_table(spark, str(tmp_path / "jobs")), []
    assert current(spark, root) == []
    for batch in range(6):
        rows = [change(rng, 100 * batch + k) for k in range(15 if batch < 5 else 3)]
        df = spark.createDataFrame(rows, CHANGES)
        apply_changes(root, df, batch, buckets=4)
        done += rows
        assert current(spark, root) == folded(done)
        # The same batch again, as after a failure.
        apply_changes(root, df, batch, buckets=4)
        assert current(spark, root) == folded(done)
    create_job_table(spark, root)
    assert current(spark, root) == folded(done)
    assert len(list(Path(root).glob("bucket=*/slot=*"))) <= 8


def test_a_batch_rewrites_the_buckets_it_touches_and_no_others(spark, tmp_path):
    rng = random.Random(5)
    root = create_job_table(spark, str(tmp_path / "jobs"))
    rows = [(k, "insert", "t", "s", None, None, None, START, k) for k in range(200)]
    assert apply_changes(root, spark.createDataFrame(rows, CHANGES), 0, buckets=8) == list(range(8))
    before = {p: p.stat().st_mtime_ns for p in Path(root).glob("bucket=*/slot=*/*.parquet")}
    one = [(7, "update", None, "done", None, "r", None, START + datetime.timedelta(days=1), 500)]
    (touched,) = apply_changes(root, spark.createDataFrame(one, CHANGES), 1, buckets=8)
    assert touched == spark.range(7, 8).select(bucket_of(F.col("id"), 8)).first()[0]
    after = {p: p.stat().st_mtime_ns for p in Path(root).glob("bucket=*/slot=*/*.parquet")}
    new = set(after) - set(before)
    assert {p: after[p] for p in before} == before
    assert {p.parent.name for p in new} == {"slot=1"} and {p.parent.parent.name for p in new} == {f"bucket={touched}"}
    assert rng and read_job_table(spark, root).filter("status = 'done'").count() == 1
    assert read_job_table(spark, root).count() == 200


def test_late_changes_and_no_changes(spark, tmp_path):
    root = create_job_table(spark, str(tmp_path / "jobs"))
    first = [(1, "insert", "t", "s", "q", None, None, START, 10)]
    apply_changes(root, spark.createDataFrame(first, CHANGES), 0, buckets=2)
    late = [(1, "update", None, "late", None, None, None, START - datetime.timedelta(days=1), 3), (2, "update", None, "unknown", None, None, None, START, 11)]
    apply_changes(root, spark.createDataFrame(late, CHANGES), 1, buckets=2)
    assert apply_changes(root, spark.createDataFrame([], CHANGES), 2, buckets=2) == []
    assert [(r.job_id, r.status) for r in read_job_table(spark, root).collect()] == [(1, "s")]


def test_changes_meet_the_table_reduced(spark):
    jobs, changes = spark.createDataFrame([], JOBS), spark.createDataFrame([], CHANGES)
    plan = merged_jobs(jobs, changes)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FullOuter") < plan.index("partial_max_by")
