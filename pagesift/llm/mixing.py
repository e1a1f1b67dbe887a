"""Mixing sources to target weights along a curriculum, with built-in functions only.

Every source has a weight, which sets how many words the mix takes from it, and a
schedule, which sets when it takes them. The integral of the schedule is the demand for
the source's words up to a moment; a document that starts after ``c`` words of its source
comes at the moment when the demand reaches ``c``. So positions of all sources are on one
scale from 0 to 1, and sorting by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.plans.scratch import written

#: Words: runs of anything but ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+"


def _inverse(demand: Column, schedule: Sequence[float]) -> Column:
    """The moment at which the integral of a schedule reaches ``demand`` of its whole.

    ``schedule`` has the weights at equal steps over the training; between them the weight
    is linear, so the demand is quadratic in each step and is solved for the moment.
    """
    steps = len(schedule) - 1
    areas = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, F.lit(1.0)
    cases = []
    for k, area in enumerate(areas):
        a, b = schedule[k], schedule[k + 1]
        left = demand * whole - before
        # Area within the step up to x (0 to 1): (a x + (b - a) x^2 / 2) / steps, in a form
        # without cancellation.
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(a * a)) + 2.0 * (b - a) * steps * left))
        x = F.when(left > 0, 2.0 * steps * left / (root + float(a))).otherwise(0.0)
        cases.append((demand * whole < before + area, (x + float(k)) / float(steps)))
        before += area
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: float) -> DataFrame:
    """``key, rank, source_size, target`` for a table ``key, source, source_size`` with one
    row per source.

    Sources in code point order, NULL last, take ``weights`` in turn and share ``share``
    times all words by weight. Nobody gets more than ``limit`` times its size; what is
    left over is shared by weight again among the others, which amounts to one level
    for all: a target is ``level * weight`` or the source's limit, whichever is less.
    The windows run over one row per source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    ranked = ranked.withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * limit)
    total = F.sum("source_size").over(everything).cast("double") * share
    ranked = ranked.withColumn("total", total).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("total") - capped) / rest
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
    ranked = ranked.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("key", "rank", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    schedules: Sequence[Sequence[float]] = ((1, 1, 2), (2, 1, 1), (1, 1, 1)),
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, positions`` and the columns in ``carry``.

    ``size`` is the number of words of the text, ``source_size`` and ``target`` belong to
    the document's source. ``positions`` holds, for every time the mix takes the whole
    document, its place between 0 and 1; ``taken`` is the size times their number.
    ``schedules`` are given to the sources in turn, like ``weights``; see ``_inverse``.

    Within a source, documents follow each other in the order of the MD5 of their ids, and
    start over at the end. A document is taken if its middle lies before the source's
    target, so a source misses its target by half a document at most, and no document is
    taken more than ``limit`` times (rounded up). The order depends on nothing but the
    rows. The running sum over a source is made per 4096th of the hash range and then
    over those, so a hot source is spread over 4096 groups.

    NULL texts have no words; they are taken like others and add none. NULL sources are a
    source of their own. Rows without an id are placed by their text instead, so many of
    them are spread as well. Equal rows stand next to each other; each counts. An empty
    table gives an empty table. Columns of ``docs`` that are not named are ignored,
    whatever their names.
    """
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), "text"), F.lit("")))
    kept = [F.col(name).alias(f"_carry_{name}") for name in carry]
    rows = docs.select("doc_id", "source", key.alias("key"), size.alias("size"), order.alias("order"), *kept)
    # Sizes and places in the order are read three times and are made once.
    rows = written(rows, "sizes").withColumn("part", F.substring("order", 1, 3))

    narrow = rows.select("doc_id", "source", "key", "size", "order")
    parts = narrow.groupBy("key", "source", F.substring("order", 1, 3).alias("part"))
    parts = parts.agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("key", "source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, limit)
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    parts = parts.select("key", "part", "before").join(targets, "key")

    running = Window.partitionBy("key", "part").orderBy("order", "doc_id", "size")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(running)).join(parts, ["key", "part"])
    rows = rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size"))

    middles = [
        (F.col("start") + F.lit(n) * F.col("source_size")).cast("double") + F.col("size") / 2.0
        for n in range(max(1, -int(-limit // 1)))
    ]
    demands = F.array(*[F.when(m < F.col("target"), m / F.col("target")) for m in middles])
    rows = rows.withColumn("demands", F.array_compact(demands))
    kind = F.col("rank") % len(schedules)
    positions = F.transform(
        "demands",
        lambda d: F.coalesce(*[F.when(kind == k, _inverse(d, s)) for k, s in enumerate(schedules)]),
    )
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("demands")).alias("taken"),
        positions.alias("positions"),
        *[F.col(f"_carry_{name}").alias(f"carry_{name}") for name in carry],
    )


def _range_sorted(rows: DataFrame, position: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, position, "doc_id").sortWithinPartitions(position, "doc_id")


def mixed_in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``mix_sources``, range-sorted by ``first_position`` over all partitions, those
    that are not taken first (NULL); ties by ``doc_id``."""
    mixed = mix_sources(docs, **options).withColumn("first_position", F.get("positions", F.lit(0)))
    # The bounds of the ranges are sampled before anything is dealt out.
    return _range_sorted(written(mixed, "mix"), "first_position")


def training_order(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "text", "lang", "source", "n_chars"), **options
) -> DataFrame:
    """The mix itself: ``columns`` and ``position``, a row each time a document is taken,
    range-sorted by ``position`` over all partitions (ties by ``doc_id``). Takes the
    options of ``mix_sources`` and treats odd rows the same."""
    mixed = mix_sources(docs, carry=columns, **options)
    taken = mixed.select(
        *[F.col(f"carry_{name}").alias(name) for name in columns], F.explode("positions").alias("position")
    )
    return _range_sorted(taken, "position")
