"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.plans.scratch import written

# A key with fewer rows than this fits a task as it is.
HOT_ROWS = 1_000_000
# A key is hot from this share of all rows, so there are at most as many hot keys.
HOT_KEYS = 100_000


def split_hot_keys_join(
    big: DataFrame,
    small: DataFrame,
    on: str,
    how: str = "inner",
    splits: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join with the rows of hot keys dealt out over several tasks.

    ``small`` has each key once. A key is hot from ``hot_rows`` rows and one in ``HOT_KEYS`` of
    all rows on, which bounds the list that is broadcast; its rows are dealt out over one task
    per ``hot_rows`` rows, ``splits`` at least, and its row in ``small`` is repeated for each.
    All other rows are joined as in a plain join, and rows without a key, which match nothing,
    are dealt out as well. The list is written once, so both sides deal by the same one, and
    the split of a row comes from its content, so a task that runs again makes the same split.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"Unsupported join '{how}'")
    splits = splits or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = big.groupBy(on).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    least = F.greatest(F.lit(hot_rows), F.col("__total") / HOT_KEYS)
    hot = counts.filter(F.col(on).isNotNull()).join(F.broadcast(total), F.col("__n") >= least)
    parts = F.greatest(F.lit(splits), F.ceil(F.col("__n") / hot_rows)).cast("int")
    hot = F.broadcast(written(hot.select(on, parts.alias("__parts")), "hot-keys"))

    row = F.xxhash64(*big.columns)
    dealt = big.join(hot, on, "left").withColumn(
        "__split",
        F.when(F.col("__parts").isNotNull(), F.pmod(row, F.col("__parts")))
        .when(F.col(on).isNull(), F.pmod(row, F.lit(splits)))
        .otherwise(0)
        .cast("int"),
    )
    last_split = F.coalesce(F.col("__parts") - 1, F.lit(0))
    repeated = small.join(hot, on, "left").withColumn(
        "__split", F.explode(F.sequence(F.lit(0), last_split))
    )
    joined = dealt.drop("__parts").join(repeated.drop("__parts"), [on, "__split"], how)
    return joined.drop("__split")
