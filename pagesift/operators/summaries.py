"""Summary prompts, and summaries by a function the caller brings."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import strip
from pagesift.schema import DEFAULT_PROMPT, NO_TEXT_NOTICE, PROMPT_CHARS, PROMPT_JOINT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_FUNCTION_NOTICE = "[Summarization needs a summary function; none was given.]"
#: How the notice of a failure begins.
FAILED = "[Summarization failed: "


def summary_prompt(text: Column, instruction: str | Column | None = None) -> Column:
    """Instruction and the first 8000 characters of the text."""
    if not isinstance(instruction, Column):
        instruction = F.lit(instruction)
    lead = F.coalesce(F.nullif(instruction.cast("string"), F.lit("")), F.lit(DEFAULT_PROMPT))
    return F.concat(lead, F.lit(PROMPT_JOINT), F.substring(text, 1, PROMPT_CHARS))


def has_summary(summary: Column) -> Column:
    """A summary that is no notice: something, and not starting with a bracket."""
    text = F.coalesce(summary, F.lit(""))
    return (text != "") & ~strip(text).startswith("[")


def summarise(
    df: DataFrame,
    fn: Callable[[str], str] | None = None,
    text: str = "full_text",
    instruction: str | Column | None = None,
    prompt: str | None = None,
) -> DataFrame:
    """``df`` with a ``summary``. The prompt is made of ``text`` and ``instruction``, or is the
    column ``prompt`` as it stands.

    ``fn`` gets a prompt and answers with text; it runs in the tasks, on prompts that
    are already cut. Without it, without text, or where it fails, the summary is a
    notice in brackets: one bad document never fails the job.
    """
    blank = strip(F.coalesce(prompt or text, F.lit(""))) == ""
    if fn is None:
        notice = F.when(blank, NO_TEXT_NOTICE).otherwise(NO_FUNCTION_NOTICE)
        return df.withColumn("summary", notice)
    whole = F.when(~blank, F.col(prompt) if prompt else summary_prompt(F.col(text), instruction))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _answer(batches, fn)

    # Asked once per row, and with the prompt alone: the other columns stay in the JVM.
    ask = F.pandas_udf(answer, "summary string").asNondeterministic()
    return df.withColumn("summary", ask(F.struct(whole.alias("summary")))["summary"])


def answers(fn: Callable[[str], str] | None, text: Column, instructions: Column) -> Column:
    """A summary of one text for each of an array of instructions, as an array; see ``summarise``."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    if fn is None:
        notice = F.when(blank, NO_TEXT_NOTICE).otherwise(NO_FUNCTION_NOTICE)
        return F.transform(instructions, lambda i: notice)
    prompts = F.transform(instructions, lambda i: F.when(~blank, summary_prompt(text, i)))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answers=[[_answer_one(p, fn) for p in asked] for asked in batch["answers"]])

    ask = F.pandas_udf(answer, "answers array<string>").asNondeterministic()
    return ask(F.struct(prompts.alias("answers")))["answers"]


def _answer(batches: Iterator[pd.DataFrame], fn: Callable[[str], str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(summary=[_answer_one(p, fn) for p in batch["summary"]])


def _answer_one(prompt: str | None, fn: Callable[[str], str]) -> str:
    if prompt is None:
        return NO_TEXT_NOTICE
    try:
        return fn(prompt)
    except Exception as error:  # noqa: BLE001 - whatever the caller's function raises
        return f"{FAILED}{error}]"
