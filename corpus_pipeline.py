"""The corpus pipeline: from documents to a mixed, ordered training set.

Every stage takes (spark, docs, folder of tables) and returns a DataFrame, which is
written and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.decontaminate import find_benchmark
from pagesift.llm.mixing import training_order
from pagesift.llm.neardup import near_duplicates
from pagesift.llm.pii import find_personal_data
from pagesift.llm.quality import score_quality
from pagesift.plans.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, carry=COLUMNS).filter("score >= 0.3").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, and of repeated rows one.

    Different texts under one id are all kept or all dropped, as their group has it. Rows
    without an id cannot be told apart by it and all stay.
    """
    docs = docs.select(*COLUMNS)
    dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(dropped, "doc_id", "left_anti")
    return named.dropDuplicates(["doc_id", "text"]).union(docs.filter("doc_id is null")).select(*COLUMNS)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_benchmark(docs, benchmark, carry=COLUMNS).filter("size(hits) = 0").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    found = find_personal_data(docs, carry=["doc_id", "lang", "source"])
    found = found.withColumn("text", F.col("redacted"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training set: a row each time a document is taken, sorted by ``position``."""
    return training_order(docs, COLUMNS)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Trained models and hashed signatures have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
