"""Summaries that are asked for once: a table of answers by prompt, kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import strip
from pagesift.operators.summaries import FAILED, summarise, summary_prompt
from pagesift.plans.choice import rows_without
from pagesift.plans.scratch import written
from pagesift.schema import NO_TEXT_NOTICE

ANSWERS = "key string, summary string"


def create_answers(spark: SparkSession, store: str) -> str:
    """An empty table of answers; does nothing to one that is there."""
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(store)
    return store


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """The answer to every prompt that was answered: the SHA-256 of the prompt, and the summary.
    Of two runs that asked at the same time one counts."""
    stored = spark.read.schema(ANSWERS).parquet(store)
    return stored.groupBy("key").agg(F.min("summary").alias("summary"))


def summaries_once(
    df: DataFrame,
    fn: Callable[[str], str],
    store: str,
    text: str = "full_text",
    instruction: str | Column | None = None,
) -> DataFrame:
    """The columns of ``df`` but ``text``, and ``summary``, as ``summarise`` gives it.

    Every different prompt is asked once, whatever the number of rows that have it, and
    never again once ``store`` has its answer; answers of this run are added there. Prompts on
    which ``fn`` failed are not stored, so the next run asks them again. Only keys and
    prompts are shuffled before the call, and no text after it. A task that runs again asks
    its prompts again.
    """
    spark = df.sparkSession
    create_answers(spark, store)
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    prompt = F.when(~blank, summary_prompt(F.col(text), instruction))
    rest = [name for name in df.columns if name != text]
    keyed = df.select(*rest, prompt.alias("__prompt")).withColumn("key", F.sha2("__prompt", 256))
    known = read_answers(spark, store)
    asked = keyed.filter("key is not null").groupBy("key").agg(F.min("__prompt").alias("__prompt"))
    asked = rows_without(written(asked, "prompts"), known, "key")
    # The prompts are whole already: the function gets them as they are.
    new = written(summarise(asked, fn, prompt="__prompt").select("key", "summary"), "answers")
    answers = written(known.unionByName(new), "all-answers")
    new.filter(~F.col("summary").startswith(FAILED)).write.mode("append").parquet(store)
    out = keyed.drop("__prompt").join(answers, "key", "left")
    return out.select(*rest, F.coalesce("summary", F.lit(NO_TEXT_NOTICE)).alias("summary"))
