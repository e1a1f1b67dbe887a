"""Near-duplicate documents: min-max hashing, bands, links confirmed on full sets.

A document's set holds its distinct shingles of ``shingle`` words, A-Z lower-cased; a
shorter text is one shingle. Under each of ``bands * rows / 2`` permutations both the
smallest and the largest value are kept, so a signature costs half the hash evaluations.
Documents that agree in all rows of one band are candidates; two that share 80 % of their
shingles meet with a probability of ``1 - (1 - 0.8^rows)^bands``, all but 1 in 8 million.

Texts with equal sets are one node from the start. Within a bucket every node is compared
with the smallest one; nodes that this leaves in different components are compared with
each other in a second step. So copies, however many, cost one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.graph import components
from pagesift.llm.text import Powers, as_bytes, in_slices, shingles, word_hashes
from pagesift.plans.choice import key_filter
from pagesift.plans.scratch import written

_CHUNK = 4096


def shingle_set(text: bytes, n: int, powers: Powers) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    hashes = word_hashes(text.lower(), powers)[0]
    return np.unique(shingles(hashes, n)) if len(hashes) else np.empty(0, np.uint64)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``count`` permutations of the 64-bit numbers."""
    drawn = np.random.default_rng(20240229).integers(0, 2**64, (2, count, 1), np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def min_max_signature(values: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The smallest and the largest value under each permutation, next to each other."""
    low = np.full(len(factors), 2**64 - 1, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for start in range(0, len(values), _CHUNK):
        hashed = values[start : start + _CHUNK] * factors + summands
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _signatures(
    batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int
) -> Iterator[pa.RecordBatch]:
    powers, (factors, summands) = Powers(), permutations((bands * rows + 1) // 2)
    for batch in in_slices(batches):
        sizes, digests, keys = [], [], []
        for text in as_bytes(batch.column(1)):
            values = shingle_set(text, shingle, powers)
            sizes.append(len(values))
            digests.append(xxhash.xxh3_128_digest(values.tobytes()))
            if len(values):
                signature = min_max_signature(values, factors, summands)[: bands * rows]
                keys.append(
                    [
                        int.from_bytes(xxhash.xxh3_64_digest(part.tobytes(), seed=band), "big", signed=True)
                        for band, part in enumerate(signature.reshape(bands, rows))
                    ]
                )
            else:
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "digest", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in in_slices(batches):
        sets = [shingle_set(text, shingle, powers) for text in as_bytes(batch.column(1))]
        digests = pa.array([xxhash.xxh3_128_digest(values.tobytes()) for values in sets], pa.binary())
        members = pa.array([values.view(np.int64) for values in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, members], names=["doc_id", "digest", "members"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    def arrays(column: pa.ListArray) -> list[np.ndarray]:
        return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])

    for batch in batches:
        if not len(batch):
            continue
        keep = []
        for a, b in zip(arrays(batch.column(2)), arrays(batch.column(3)), strict=True):
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Linked are documents whose shingle sets have ``100 * common >= percent * union``.
    ``component_id`` is the smallest ``doc_id`` that links reach, and ``kept`` marks the
    document that has it. Missing and blank texts have an empty set and stand alone. An id with
    several texts is one document, linked with whatever one of its texts is. Rows
    without ``doc_id`` are linked with nothing: ``component_id`` NULL, ``kept`` true. Equal
    rows get equal results, so a repeated ``doc_id`` is kept or not as a whole. Other
    columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    marked = docs.mapInArrow(
        partial(_signatures, shingle=shingle, bands=bands, rows=rows),
        "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>",
    )
    marked = written(marked, "signatures")
    texts = marked.filter("n_shingles > 0 and doc_id is not null")
    # A node is a set, whatever ids have it; an id with several texts ties their nodes together.
    # Nodes are numbered in the order of their ids: an original mostly comes before its edited copies,
    # and as the smallest of a bucket it is nearer to each of them than they are to each other.
    nodes = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nodes = nodes.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    several = texts.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("most"))
    several = several.filter("digest < most").join(nodes.select("digest", F.col("node").alias("other")), "digest")
    tied = texts.join(several.select("doc_id", "other"), "doc_id").select("digest", "other").distinct()
    tied = tied.join(nodes.select("digest", "node"), "digest").select("node", "other").filter("node != other")
    first = texts.join(nodes, ["digest", "doc_id"]).dropDuplicates(["node"])
    keys = first.select("node", F.explode("bands").alias("key"))

    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n"))
    leaders = leaders.filter("n > 1").drop("n")
    starred = keys.join(leaders, "key").filter("node > leader")
    stars = starred.select("node", F.col("leader").alias("other")).distinct()
    stars = written(stars, "candidates")
    sets = written(_members(stars, nodes, docs, shingle), "sets")
    links = written(_confirmed(stars, sets, percent).union(tied), "confirmed")
    grouped = components(links, "node", "other")

    # Buckets that still hold several components: those pairs were not compared yet.
    named = starred.join(grouped, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = mixed.filter("least < most").select("key")
    rest = named.join(mixed, "key", "left_semi").select("node", "component").distinct()
    more = _confirmed(_overlapping(written(rest, "rest"), sets, percent), sets, percent)
    grouped = components(links.union(more), "node", "other")

    named = nodes.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component").select("digest", F.col("least").alias("component"))
    out = marked.join(named, "digest", "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), alone)
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _members(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``node, members``: the shingle sets of all nodes in ``pairs``. Sets are made where the texts
    lie, and only sets are shuffled."""
    wanted = pairs.select("node").union(pairs.select("other")).distinct()
    wanted = written(nodes.join(wanted, "node"), "wanted")
    texts = docs.filter(key_filter(wanted, "doc_id")(F.col("doc_id")))
    made = texts.mapInArrow(partial(_sets, shingle=shingle), "doc_id bigint, digest binary, members array<bigint>")
    once = made.groupBy("doc_id", "digest").agg(F.first("members").alias("members"))
    return once.join(wanted, ["doc_id", "digest"]).select("node", "members")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (node, other) that are linked by their full sets."""
    theirs = sets.select(F.col("node").alias("other"), F.col("members").alias("other_members"))
    joined = pairs.join(sets, "node").join(theirs, "other")
    joined = joined.select("node", "other", "members", "other_members")
    return joined.mapInArrow(partial(_linked, percent=percent), "node bigint, other bigint")


def _overlapping(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (node, component) across components that may still be linked.

    With every set sorted by how few of the nodes have a shingle, two linked sets meet
    within their first ``size - percent * size + 1`` shingles, and what is left of both
    behind the place where they meet is enough for the overlap that a link needs. Edited
    copies begin with what only they have, so hardly any unlinked pair passes. No linked
    pair is lost.
    """
    members = nodes.join(sets, "node")
    tokens = members.select("node", "component", F.explode("members").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").groupBy("node", "component")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    size = F.size("ranked")
    prefix = F.slice("ranked", 1, size - F.ceil(size * percent / F.lit(100)).cast("int") + 1)
    probes = ranked.select(
        "node", "component", size.alias("size"), F.posexplode(prefix).alias("place", "shingle")
    ).filter("shingle.often > 1")
    probes = probes.select("node", "component", "size", "place", F.col("shingle.token").alias("token"))
    probes = written(probes, "probes")
    mine, theirs = probes.alias("a"), probes.alias("b")
    left = F.least(F.expr("a.size - a.place"), F.expr("b.size - b.place"))
    enough = left * (100 + percent) >= percent * F.expr("a.size + b.size")
    met = mine.join(
        theirs,
        (F.expr("a.token = b.token and a.node > b.node and a.component != b.component")) & enough,
    )
    pairs = met.select(F.col("a.node").alias("node"), F.col("b.node").alias("other")).distinct()
    return written(pairs, "candidates")
