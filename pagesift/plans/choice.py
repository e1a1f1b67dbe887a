"""Rows chosen by a list of keys of any length, without shuffling the other rows.

A Bloom filter of the keys is built by aggregation and travels as one array of 64-bit words; a
key has all its bits in one of them. Rows that the filter refuses are in no way among the
keys and stay where they are; only the rows it lets through meet the keys in a join, which
decides. Nothing but the filter is broadcast on purpose, and its size is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.plans.scratch import written

#: Keys for each word of the filter: about 1 in 40 other rows passes.
KEYS_PER_WORD = 5
#: Bits that a key sets in its word.
PROBES = 4
#: The largest filter, 16 MB. It holds 10 million keys at that rate; with more of them more rows
#: pass and take part in the join, and the result is the same.
MOST_WORDS = 1 << 21


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key and its bits there."""
    whole = F.xxhash64(key)
    low = whole.bitwiseAND(F.lit(0xFFFFFFFF))
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.shiftrightunsigned(whole, 32 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.shiftrightunsigned(low * words, 32).cast("int"), mask


def key_filter(keys: DataFrame, name: str, most_words: int = MOST_WORDS) -> Callable[[Column], Column]:
    """A function from a column to whether it may be among ``keys[name]``; never wrongly no.

    ``keys`` should be a stored table, as it is read here and again by what follows. A NULL
    is not among the keys.
    """
    known = keys.select(F.col(name).alias("key")).filter("key is not null")
    words = min(known.count() // KEYS_PER_WORD + 1, most_words)
    word, mask = _place(F.col("key"), words)
    filled = known.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    every = keys.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("word"))
    dense = every.join(filled, "word", "left").select("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    row = dense.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("held"))
    held = written(row.select(F.transform("held", lambda w: w["mask"]).alias("held")), "key-filter")

    def may_be(column: Column) -> Column:
        word, mask = _place(column, words)
        passed = F.get(held.scalar(), word).bitwiseAND(mask) == mask
        return F.coalesce(column.isNotNull() & passed, F.lit(False))

    return may_be


def rows_among(rows: DataFrame, keys: DataFrame, name: str, **options) -> DataFrame:
    """``rows`` joined with ``keys`` on a column both have: an inner join."""
    return rows.filter(key_filter(keys, name, **options)(F.col(name))).join(keys, name)


def rows_without(rows: DataFrame, keys: DataFrame, name: str, **options) -> DataFrame:
    """The rows whose key is not among ``keys``, also those without one. Reads ``rows`` twice."""
    may_be = key_filter(keys, name, **options)(F.col(name))
    doubtful = rows.filter(may_be).join(keys.select(name), name, "left_anti")
    return rows.filter(~may_be).unionByName(doubtful)
