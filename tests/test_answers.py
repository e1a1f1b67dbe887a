"""Every prompt is asked once: in a run, over runs, and again only after a failure."""

from pagesift.operators.summaries import NO_TEXT_NOTICE, summarise
from pagesift.plans.answers import create_answers, read_answers, summaries_once


def test_prompts_are_asked_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    store = str(tmp_path / "store")

    def fn(prompt):
        calls.add(1)
        if "bad" in prompt:
            raise RuntimeError("no")
        return prompt.rsplit("\n", 1)[1].upper()

    texts = ["one", "two", "bad"] * 20 + ["", " ", None]
    rows = [(n, text, "kept") for n, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, full_text string, summaries string").repartition(7)
    plain = {r.doc_id: r.summary for r in summarise(df, fn, instruction="Say:").collect()}
    calls.value = 0
    for run in range(3):
        got = summaries_once(df, fn, store, instruction="Say:")
        assert got.columns == ["doc_id", "summaries", "summary"]
        assert {r.doc_id: r.summary for r in got.collect()} == plain
        # Three prompts at first, then the one that failed.
        assert calls.value == 3 + run
    assert plain[62] == NO_TEXT_NOTICE and read_answers(spark, store).count() == 2
    other = summaries_once(df.filter("doc_id < 2"), fn, store, instruction="Tell:")
    assert {r.summary for r in other.collect()} == {"ONE", "TWO"} and calls.value == 7


def test_empty_tables_and_stores(spark, tmp_path):
    store = create_answers(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([], "doc_id int, full_text string")
    assert summaries_once(df, str.upper, store).count() == 0
    create_answers(spark, store)
    assert read_answers(spark, store).count() == 0
