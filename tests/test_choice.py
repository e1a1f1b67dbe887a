"""Rows chosen by keys: exact for any filter size, and other rows are not shuffled."""

import pytest
from pyspark.sql import functions as F

from pagesift.plans.choice import key_filter, rows_among, rows_without


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("choice"))
    rows = spark.range(0, 50_000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://é/"), F.col("id") % 20_000)).alias("url"),
        F.repeat(F.lit("x"), 50).alias("html"),
    )
    rows.write.parquet(f"{root}/rows")
    keys = spark.range(0, 20_000, 7).select(F.concat(F.lit("https://é/"), F.col("id")).alias("url"))
    keys.unionByName(spark.createDataFrame([(None,)], "url string")).write.parquet(f"{root}/keys")
    return spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{root}/keys")


@pytest.mark.parametrize("most_words", [1, 100, 1 << 21])
def test_results_are_those_of_plain_joins(stored, most_words):
    rows, keys = stored
    among = rows_among(rows, keys, "url", most_words=most_words)
    assert among.count() == rows.join(keys, "url").count() > 0
    without = rows_without(rows, keys, "url", most_words=most_words)
    assert without.count() == rows.join(keys, "url", "left_anti").count()
    assert without.filter("url is null").count() == 5000


def test_no_keys(stored):
    rows, keys = stored
    assert rows_among(rows, keys.filter("false"), "url").count() == 0
    assert rows_without(rows, keys.filter("false"), "url").count() == rows.count()


def test_few_other_rows_pass(stored):
    rows, keys = stored
    passed = rows.filter(key_filter(keys, "url")(F.col("url")))
    right = rows.join(keys, "url", "left_semi").count()
    assert right <= passed.count() < 1.3 * right


def test_the_filter_comes_before_the_shuffle_however_many_keys(spark, stored):
    rows, keys = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows_among(rows, keys, "url")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[: plan.index("ReadSchema: struct<url:string,html:string>")]
    exchange, subquery = side.rindex("Exchange hashpartitioning(url"), side.rindex("Subquery subquery")
    assert "SortMergeJoin" in plan and exchange < subquery
