"""SimHash fingerprints, and permuted block tables to find near ones.

The terms of a text, its pairs of consecutive words, vote on each bit of the fingerprint
with the logarithm of their count. Fingerprints that differ in at most ``radius`` of
``radius + keys`` blocks of bits agree in ``keys`` of them, so there is one table per
choice of ``keys`` blocks, keyed by their bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.text import Powers, mix, shingles, word_hashes
from pagesift.plans.scratch import written

BITS = 256
_CHUNK = 4096
_LANES = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: str, powers: Powers) -> np.ndarray:
    """The fingerprint of a whole text as bytes; zeros if it has no words."""
    hashes = word_hashes(text.lower().encode(), powers)[0]
    if not len(hashes):
        return np.zeros(BITS // 8, np.uint8)
    terms, counts = np.unique(shingles(hashes, 2), return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS, np.float32)
    for start in range(0, len(terms), _CHUNK):
        lanes = mix(terms[start : start + _CHUNK, None] ^ _LANES)
        votes += weights[start : start + _CHUNK] @ np.unpackbits(lanes.view(np.uint8), axis=1)
    return np.packbits(votes * 2 > weights.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of the angle that the share of differing bits stands for; 0 if it is obtuse."""
    differing = int(np.unpackbits(a ^ b).sum())
    return max(0.0, math.cos(math.pi * differing / BITS))


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as much of the beginning of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part; guests end a part and only serve as the document that follows."""
    powers, before = Powers(), None
    for batch in batches:
        rows = []
        for part, guest, doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            text = text or ""
            print_ = fingerprint(text, powers)
            if before is not None and before[0] == part and not before[1]:
                rows.append(_row(*before[2:], text, print_, powers))
            before = (part, guest, doc_id, text, print_)
        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


_ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _row(doc_id, text: str, own: np.ndarray, other: str, others: np.ndarray, powers: Powers) -> dict:
    changed = edited(text, other)
    after = fingerprint(changed, powers)
    values = (
        doc_id,
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        own.tobytes().hex(),
        after.tobytes().hex(),
        likeness(own, after),
        likeness(own, others),
    )
    return dict(zip(_ROW.names, values, strict=True))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``, one row for each row of ``docs``.

    The next document is that with the next smaller ``doc_id``, after the last one the
    first; a single document follows itself. Rows of one id follow each other by text, and
    rows without id come last. Missing texts count as empty; an empty text has the
    fingerprint of zeros. Ids are cut into ranges of about equal numbers of rows, which
    are walked one by one; each range also gets the first row of the one after it. An
    empty table gives an empty table. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    parts = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 100 * parts)).first()[0]
    bounds = np.array(sorted(set(found or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        missing = doc_id.isna()
        found = len(bounds) - np.searchsorted(bounds, doc_id.fillna(0).astype("int64"), "left")
        return pd.Series(found).where(~missing.to_numpy(), len(bounds) + 1).astype("int32")

    # The first id of each part, for the part before; as many rows as there are parts.
    ids = docs.select("doc_id", part_of("doc_id").alias("part"))
    heads = sorted(tuple(row) for row in ids.groupBy("part").agg(F.max("doc_id")).collect())
    guests = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(guests, "head bigint, before int")
    marked = docs.withColumn("part", part_of("doc_id"))
    marked = marked.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, visit))
    placed = marked.select(F.inline(places), "doc_id", "text")
    order = ["part", "guest", F.col("doc_id").desc_nulls_last(), "text"]
    return placed.repartition("part").sortWithinPartitions(*order).mapInArrow(_walk, _ddl())


def _ddl() -> str:
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{field.name} {kinds[field.type]}" for field in _ROW)


def _tables(batches: Iterator[pa.RecordBatch], radius: int, keys: int) -> Iterator[pa.RecordBatch]:
    """The keys of each fingerprint in every table, and its bits as four numbers."""
    blocks = np.array_split(np.arange(BITS), radius + keys)
    choices = [np.concatenate(chosen) for chosen in combinations(blocks, keys)]
    for batch in batches:
        prints = batch.column(0).to_pylist()
        raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(-1, BITS // 8)
        bits = np.unpackbits(raw, axis=1)
        packed = [np.packbits(bits[:, choice], axis=1) for choice in choices]
        found = [
            [
                int.from_bytes(xxhash.xxh3_64_digest(table[n].tobytes(), seed=k), "big", signed=True)
                for k, table in enumerate(packed)
            ]
            for n in range(len(prints))
        ]
        words = raw.view(">i8").astype(np.int64)
        columns = [pa.array(words[:, k]) for k in range(words.shape[1])]
        names = [f"w{k}" for k in range(len(columns))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), *columns, pa.array(found, pa.list_(pa.int64()))], names=["n", *names, "keys"]
        )


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = 7, keys: int = 1) -> DataFrame:
    """``fingerprint, other, n``: for every fingerprint in ``queries`` all those of ``prints``
    that differ from it in at most ``radius`` bits, itself included, and in how many rows
    of ``prints`` they occur.

    Equal fingerprints are one from the start, so copies cost nothing. Missing ones are
    ignored. A pair is found in every table in which it agrees, and listed once.
    """
    words = [f"w{k}" for k in range(BITS // 64)]
    ddl = f"n bigint, {', '.join(f'{w} bigint' for w in words)}, keys array<bigint>"

    def tables(df: DataFrame) -> DataFrame:
        counted = df.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
        keyed = counted.mapInArrow(partial(_tables, radius=radius, keys=keys), ddl)
        return keyed.select("n", *words, F.explode("keys").alias("key"))

    def hexed(side: str) -> Column:
        return F.concat(*[F.lower(F.lpad(F.hex(f"{side}.{w}"), 16, "0")) for w in words])

    asked, there = tables(queries).drop("n").alias("q"), tables(prints).alias("p")
    differing = F.expr(" + ".join(f"bit_count(q.{w} ^ p.{w})" for w in words))
    met = asked.join(there, (F.expr("q.key = p.key")) & (differing <= radius))
    return met.select(hexed("q").alias("fingerprint"), hexed("p").alias("other"), "p.n").distinct()


def search_every(docs: DataFrame, step: int = 20, radius: int = 7, keys: int = 1) -> DataFrame:
    """``fingerprints(docs)`` and ``n_near``: for documents whose id is divisible by ``step``, how
    many other rows have a fingerprint within ``radius``; NULL for the rest."""
    prints = written(fingerprints(docs), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % step == 0, F.lit(False))
    asked = prints.filter(asks)
    pairs = near_fingerprints(asked.select("fingerprint"), prints.select("fingerprint"), radius, keys)
    near = pairs.groupBy("fingerprint").agg((F.sum("n") - 1).alias("n_near"))
    rest = prints.filter(~asks).withColumn("n_near", F.lit(None).cast("bigint"))
    return asked.join(near, "fingerprint", "left").select(*rest.columns).union(rest)
