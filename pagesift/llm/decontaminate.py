"""Benchmark items in training documents: rare n-gram seeds, then Smith-Waterman alignment.

A first pass counts in how many documents each n-gram of the benchmark occurs. A second
one looks for the rarest of each item; where a document has one, the words around it are
aligned with the item. Words are compared without case and ASCII punctuation, so copies
with edited words, punctuation or case still align.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.text import Powers, add_results, as_bytes, shingles, word_hashes

#: So much benchmark text is broadcast at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
_PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_PLAIN = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_FILTER_BITS = 20
MATCH, MISMATCH, GAP = 2, -1, -1
_HITS = "array<struct<item_id: bigint, score: double, start: int, end: int>>"


class Item(NamedTuple):
    item_id: int
    words: np.ndarray
    grams: np.ndarray


class Seeds(NamedTuple):
    """Seed hashes in order, the items of each, and a table of some bits of their hashes."""

    length: int
    hashes: np.ndarray
    owners: list[list[int]]
    table: np.ndarray


def plain(text: bytes) -> bytes:
    """Lower case of every script, ASCII punctuation as blanks."""
    lower = text.lower() if text.isascii() else text.decode(errors="replace").lower().encode()
    return lower.translate(_PLAIN)


def read_items(rows: list, n: int) -> list[Item]:
    """Items with their words and distinct n-grams. One of fewer words is one n-gram."""
    powers, items = Powers(), []
    for row in rows:
        words = word_hashes(plain((row["text"] or "").encode()), powers)[0]
        if len(words):
            items.append(Item(row["item_id"], words, np.unique(shingles(words, n))))
    return items


def make_seeds(items: list[Item], n: int, chosen: list[np.ndarray]) -> list[Seeds]:
    """Seeds by their number of words: ``n``, and fewer for shorter items."""
    out = []
    for length in sorted({min(n, len(item.words)) for item in items}):
        owners: dict[int, list[int]] = {}
        for k, item in enumerate(items):
            if min(n, len(item.words)) == length:
                for gram in chosen[k].tolist():
                    owners.setdefault(gram, []).append(k)
        hashes = np.array(sorted(owners), np.uint64)
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        out.append(Seeds(length, hashes, [owners[h] for h in hashes.tolist()], table))
    return out


def seed_hits(words: np.ndarray, seeds: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document that begin a seed, and which seed."""
    if len(words) < seeds.length or not len(seeds.hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = shingles(words, seeds.length)
    places = np.flatnonzero(seeds.table[grams >> np.uint64(64 - _FILTER_BITS)])
    which = np.searchsorted(seeds.hashes, grams[places])
    found = seeds.hashes[np.minimum(which, len(seeds.hashes) - 1)] == grams[places]
    return places[found], which[found]


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment: its score, and the first and last word of the passage.

    One row per word of the item; gaps along the passage are a running maximum.
    """
    slope = np.arange(len(passage)) * -GAP
    above, origin = np.zeros(len(passage) + 1, np.int64), np.arange(len(passage) + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        vertical = above[1:] + GAP
        value = np.maximum(diagonal, vertical)
        start = np.where(diagonal >= vertical, origin[:-1], origin[1:])
        fresh = value <= 0
        value = np.where(fresh, 0, value)
        start = np.where(fresh, np.arange(1, len(passage) + 1), start)
        lifted = value + slope
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(len(passage)), 0))
        row = reach - slope
        above[1:], origin[1:] = row, start[source]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(origin[top + 1]), top)
    return best


def find_items(
    text: bytes, items: list[Item], seeds: list[Seeds], threshold: float, powers: Powers
) -> list[tuple[int, float, int, int]]:
    """``(item_id, score, start, end)`` for items in a text: the best alignment of each,
    with numbers of words. Exact upper bounds spare most alignments."""
    words = word_hashes(plain(text), powers)[0]
    near: dict[int, list[int]] = {}
    for group in seeds:
        for place, which in zip(*seed_hits(words, group), strict=True):
            for k in group.owners[which]:
                near.setdefault(k, []).append(int(place))
    found = []
    for k, places in near.items():
        item, best = items[k], (0, 0, 0)
        reach = 2 * len(item.words)
        whole = MATCH * len(item.words)
        begin = None
        for place in [*sorted(places), None]:
            if begin is not None and (place is None or place - reach > until):
                passage = words[begin : until + 1]
                shared = min(np.isin(passage, item.words).sum(), np.isin(item.words, passage).sum())
                if MATCH * shared >= threshold * whole:
                    score, first, last = align(passage, item.words)
                    if score > best[0]:
                        best = (score, begin + first, begin + last)
                begin = None
            if place is not None:
                begin = max(0, place - reach) if begin is None else begin
                until = min(len(words) - 1, place + reach)
        if best[0] >= threshold * whole:
            found.append((item.item_id, best[0] / whole, best[1], best[2] + 1))
    return sorted(found)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark in blocks of bounded size, by item."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-4 * total // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        yield sorted(items.filter(part == k).collect(), key=lambda row: (row["item_id"] is None, row))


def _rare(docs: DataFrame, items: list[Item], n: int, rarest: int) -> list[np.ndarray]:
    """Of each item its rarest n-grams over all documents: half of them, ``rarest`` at least."""
    everything = make_seeds(items, n, [item.grams for item in items])
    shared = docs.sparkSession.sparkContext.broadcast(everything)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seeds = Powers(), shared.value
        counts = [np.zeros(len(group.hashes), np.int64) for group in seeds]
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                words = word_hashes(plain(text), powers)[0]
                for group, of in zip(seeds, counts, strict=True):
                    of[np.unique(seed_hits(words, group)[1])] += 1
        for k, of in enumerate(counts):
            which = np.flatnonzero(of)
            rows = [pa.array(np.full(len(which), k)), pa.array(which), pa.array(of[which])]
            yield pa.RecordBatch.from_arrays(rows, names=["k", "which", "docs"])

    found = docs.select("text").mapInArrow(count, "k bigint, which bigint, docs bigint")
    often: dict[tuple[int, int], int] = {}
    for row in found.groupBy("k", "which").agg(F.sum("docs").alias("docs")).collect():
        often[int(everything[row["k"]].hashes[row["which"]]), everything[row["k"]].length] = row["docs"]
    chosen = []
    for item in items:
        length = min(n, len(item.words))
        order = sorted(item.grams.tolist(), key=lambda gram: (often.get((gram, length), 0), gram))
        chosen.append(np.array(order[: max(rarest, len(order) // 2)], np.uint64))
    return chosen


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 4,
    rarest: int = 16,
    threshold: float = 0.5,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns in ``carry`` and ``hits``: the benchmark items in each document.

    A hit has ``item_id``, ``score`` (1: every word of the item in order) and the place of
    the aligned passage among the document's words, ``start`` to ``end``, exclusive; hits
    are sorted by item and have a score of ``threshold`` or more. One row for each row of
    ``docs``.

    Missing and empty texts have no hits, nor have items without words, and without items
    there are none at all. Equal items are found each on its own; equal rows get equal
    hits. Other columns are ignored. Rarity is relative to the item, so an item that
    stands in every document still has seeds. What is broadcast is a block of at most
    ``BLOCK_BYTES`` of benchmark; more of them mean more passes.
    """
    out = docs.select(*dict.fromkeys([*carry, "text"]))
    out = out.withColumn("__hits", F.array().cast(_HITS))
    session = docs.sparkSession
    for rows in _blocks(benchmark):
        items = read_items(rows, n)
        if not items:
            continue
        seeds = make_seeds(items, n, _rare(docs, items, n, rarest))
        shared = session.sparkContext.broadcast((items, seeds))

        def make(shared=shared) -> Callable:
            powers = Powers()

            def per_batch(column: pa.Array) -> list[pa.Array]:
                found = [find_items(text, *shared.value, threshold, powers) for text in as_bytes(column)]
                kind = pa.list_(
                    pa.struct(
                        [("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]
                    )
                )
                names = ("item_id", "score", "start", "end")
                return [pa.array([[dict(zip(names, hit, strict=True)) for hit in hits] for hits in found], kind)]

            return per_batch

        out = add_results(out, out.columns, make, f"__more {_HITS}")
        out = out.withColumn("__hits", F.concat("__hits", "__more")).drop("__more")
    return out.select(*carry, F.array_sort("__hits").alias("hits"))
