"""Passages that repeat across documents: super-k-mers, one bucket per minimiser.

A window is ``window`` consecutive words. Its minimiser is the smallest hash among its runs
of ``run`` words; consecutive windows with one minimiser travel together as one packed
string, to the bucket of the minimiser, so equal windows meet. There the strings are
sorted by document, so the first document that has a window is the smallest one. Strings
travel compressed with one dictionary, trained on some of them; that changes their size only.

Buckets that many documents share are found from a sample of documents, and only spread
the work: their windows travel one by one, each to a bucket of its own, and with their words only
once per task and smallest document; for the rest a mark travels, to any bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.text import Powers, as_bytes, in_slices, mix, shingles, word_hashes
from pagesift.plans.choice import key_filter, rows_without
from pagesift.plans.scratch import written

#: Windows of one bucket that a task holds; what comes after is settled by a join.
HELD = 700_000
#: Windows that a task remembers of hot buckets, and windows in one packed string.
REMEMBERED = 100_000
LONGEST = 64
#: One in so many documents tells which buckets are hot.
SAMPLED = 64
_LEAST = 32
#: Packed strings that the dictionary is trained on, as many of one document, and its bytes.
TAUGHT = 20_000
_TAUGHT_EACH = 64
_DICTIONARY = 32 << 10
# Rows put into one Arrow batch.
_ROWS = 50_000
# In front of what is no packed string but the hash of a window that is known to repeat.
# No compressed string starts with it: it has a bit set that frames must not use.
_KNOWN = b"\n"


def super_k_mers(text: bytes, window: int, run: int, powers: Powers):
    """The words of a text joined by blanks, their bounds, and per packed string its bucket,
    its first window and the number of its windows."""
    words = b" ".join(text.split())
    hashes, starts, ends = word_hashes(words, powers)
    if len(hashes) < window:
        none = np.empty(0, np.int64)
        return words, starts, ends, none.astype(np.int32), none, none
    grams = mix(shingles(hashes, run))
    least, width = grams, 1
    while width < window - run + 1:
        step = min(width, window - run + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    firsts = np.concatenate([[0], cuts])
    counts = np.diff(np.append(firsts, len(least)))
    if counts.max() > LONGEST:
        pieces = -(-counts // LONGEST)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(counts, pieces) - within * LONGEST
        firsts = np.repeat(firsts, pieces) + within * LONGEST
        counts = np.minimum(left, LONGEST)
    buckets = (least[firsts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return words, starts, ends, buckets, firsts, counts


_TRAVELS = "bucket int, doc_id bigint, start int, packed binary"
_FOUND = "doc_id bigint, start int, n int, check bigint, words binary"


def _check(words: bytes) -> int:
    return xxhash.xxh3_64_intdigest(words) - 2**63


def _batch(columns: tuple, kinds: tuple, names: str) -> pa.RecordBatch:
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in names.split(", ")])


class _Coder:
    """Short strings to and from frames without magic number, checksum and dictionary id."""

    def __init__(self, taught: bytes | None) -> None:
        learnt = zstandard.ZstdCompressionDict(taught) if taught else None
        form = zstandard.FORMAT_ZSTD1_MAGICLESS
        params = zstandard.ZstdCompressionParameters.from_level(
            3, format=form, write_content_size=True, write_checksum=False, write_dict_id=False
        )
        if learnt:
            learnt.precompute_compress(compression_params=params)
        self.code = zstandard.ZstdCompressor(dict_data=learnt, compression_params=params).compress
        self._decode = zstandard.ZstdDecompressor(dict_data=learnt, format=form).decompress

    def decode(self, packed: bytes) -> bytes:
        return packed if packed[:1] == _KNOWN else self._decode(packed)


def _pack(
    batches: Iterator[pa.RecordBatch], window: int, run: int, hot: list[int], taught: bytes | None
) -> Iterator[pa.RecordBatch]:
    """Packed strings, and windows of hot buckets one by one."""
    code = _Coder(taught).code
    powers, seen, hot = Powers(), {}, np.array(hot, np.int32)
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    out: tuple[list, ...] = ([], [], [], [])

    for batch in in_slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if doc_id is None:
                continue
            words, starts, ends, buckets, firsts, counts = super_k_mers(text, window, run, powers)
            if len(hot):
                is_hot = np.isin(buckets, hot)
                for first, n in zip(firsts[is_hot].tolist(), counts[is_hot].tolist(), strict=True):
                    for k in range(first, first + n):
                        one = words[starts[k] : ends[k + window - 1]]
                        known = seen.get(one)
                        digest = xxhash.xxh3_64_digest(one)
                        if known is not None and known < doc_id:
                            packed = _KNOWN + digest
                        else:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[one], packed = doc_id, code(one)
                        # What is known already needs no bucket of its kind, so it is dealt out.
                        spot = digest if packed[:1] != _KNOWN else xxhash.xxh3_64_digest(b"%d %d" % (doc_id, k))
                        bucket = int.from_bytes(spot[:4], "big", signed=True)
                        for column, value in zip(out, (bucket, doc_id, k, packed), strict=True):
                            column.append(value)
                buckets, firsts, counts = buckets[~is_hot], firsts[~is_hot], counts[~is_hot]
            out[0].extend(buckets.tolist())
            out[1].extend([doc_id] * len(buckets))
            out[2].extend(firsts.tolist())
            bounds = zip(starts[firsts].tolist(), ends[firsts + counts + window - 2].tolist(), strict=True)
            out[3].extend([code(words[a:b]) for a, b in bounds])
            if len(out[0]) >= _ROWS:
                yield _batch(out, kinds, _TRAVELS)
                out = ([], [], [], [])
    if out[0]:
        yield _batch(out, kinds, _TRAVELS)


def _windows(packed: pa.Array, window: int) -> tuple[bytes, list, list, list]:
    """All windows of a column of packed strings: the bytes, the bounds of every window in
    them, and for every row which windows are its own."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    text = data.to_pybytes() if data is not None else b""
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8)[: offsets[-1]] == 32)
    blanks = blanks[blanks >= offsets[0]]
    begins = np.sort(np.concatenate([offsets[:-1], blanks + 1]))
    ends = np.sort(np.concatenate([blanks, offsets[1:]]))
    first_word = np.searchsorted(begins, offsets)
    counts = np.maximum(np.diff(first_word) - window + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    word = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) + np.repeat(first_word[:-1], counts)
    return text, begins[word].tolist(), ends[word + window - 1].tolist(), bounds.tolist()


def _first_seen(
    batches: Iterator[pa.RecordBatch], window: int, held: int, taught: bytes | None
) -> Iterator[pa.RecordBatch]:
    """Windows that repeat, and windows to settle elsewhere (with their words), of sorted buckets."""
    current, first, decode = None, {}, _Coder(taught).decode
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])

        def tell(*values, out=out) -> None:
            for column, value in zip(out, values, strict=True):
                column.append(value)

        packed = pa.array([decode(one) for one in batch.column(3).to_pylist()], pa.binary())
        text, begins, ends, bounds = _windows(packed, window)
        offsets = np.frombuffer(packed.buffers()[1], np.int32).tolist()
        for row, (bucket, doc_id, start) in enumerate(
            zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        ):
            if text[offsets[row]] == 10:
                tell(doc_id, start, 1, int.from_bytes(text[offsets[row] + 1 : offsets[row] + 9], "big") - 2**63, None)
                continue
            if bucket != current:
                current, first = bucket, {}
            low, begun = bounds[row], -1
            for k in range(low, bounds[row + 1]):
                one = text[begins[k] : ends[k]]
                known = first.get(one)
                if known is not None:
                    if known < doc_id:
                        if begun < 0:
                            begun = k
                        continue
                elif len(first) < held:
                    first[one] = doc_id
                else:
                    # Full, and so it will be for every occurrence of this window.
                    tell(doc_id, start + k - low, 1, _check(one), one)
                if begun >= 0:
                    tell(doc_id, start + begun - low, k - begun, _check(text[begins[begun] : ends[k - 1]]), None)
                    begun = -1
            if begun >= 0:
                k = bounds[row + 1]
                tell(doc_id, start + begun - low, k - begun, _check(text[begins[begun] : ends[k - 1]]), None)
        yield _batch(out, kinds, _FOUND)


def _hot_buckets(docs: DataFrame, window: int, run: int) -> list[int]:
    """Buckets with more than a quarter of a task's share of the packed strings, by sampled
    documents. There are at most four for each shuffle partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, found = Powers(), Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found.update(super_k_mers(text, window, run, powers)[3].tolist())
        keys, values = pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())
        yield pa.RecordBatch.from_arrays([keys, values], names=["bucket", "n"])

    most = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    counted = sampled.select("text").mapInArrow(count, "bucket int, n bigint")
    counted = counted.groupBy("bucket").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    often = counted.filter(F.col("n") >= _LEAST).withColumn("total", total)
    often = often.filter(F.col("n") * most > F.col("total")).orderBy(F.desc("n"), "bucket").limit(most)
    return [row["bucket"] for row in often.collect()]


def _taught(docs: DataFrame, window: int, run: int) -> bytes | None:
    """A dictionary from at most ``TAUGHT`` packed strings of sampled documents; none where
    they are too few to train one."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                words, starts, ends, _, firsts, counts = super_k_mers(text, window, run, powers)
                picked = slice(None, None, -(-len(firsts) // _TAUGHT_EACH) or 1)
                firsts, lasts = firsts[picked], (firsts + counts + window - 2)[picked]
                bounds = zip(starts[firsts].tolist(), ends[lasts].tolist(), strict=True)
                shown = pa.array([words[a:b] for a, b in bounds], pa.binary())
                yield pa.RecordBatch.from_arrays([shown], names=["packed"])

    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 1)
    strings = sampled.select("text").mapInArrow(some, "packed binary").limit(TAUGHT)
    try:
        return zstandard.train_dictionary(
            _DICTIONARY, [bytes(row["packed"]) for row in strings.collect()], level=3
        ).as_bytes()
    except zstandard.ZstdError:
        return None


def repeated_windows(
    docs: DataFrame, window: int = 13, run: int = 2, held: int = HELD, hot: list[int] | None = None
) -> DataFrame:
    """``doc_id, start, n, check``: windows ``start`` to ``start + n`` of a document that also
    start in one with a smaller ``doc_id``, and a hash of their words.

    A task holds at most ``held`` windows of a bucket; those beyond are settled by grouping them.
    """
    docs = docs.select("doc_id", "text")
    hot = _hot_buckets(docs, window, run) if hot is None else hot
    taught = _taught(docs, window, run)
    packed = docs.mapInArrow(partial(_pack, window=window, run=run, hot=hot, taught=taught), _TRAVELS)
    ordered = packed.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    found = ordered.mapInArrow(partial(_first_seen, window=window, held=held, taught=taught), _FOUND)
    found = written(found, "repeats")
    late = found.filter("words is not null")
    least = late.groupBy("words").agg(F.min("doc_id").alias("least"))
    settled = late.join(least, "words").filter("doc_id > least")
    return found.filter("words is null").drop("words").union(settled.select("doc_id", "start", "n", "check"))


def _kept(text: bytes, runs: list, window: int) -> tuple[int, int, str]:
    """Words, removed words, and what is kept, joined by blanks."""
    words = text.split()
    covered = np.zeros(len(words) + 1, np.int32)
    for run in runs:
        start, end = run["start"], run["start"] + run["n"] + window - 1
        # Rows of one id may have different texts; a run belongs to those that have its words.
        if end <= len(words) and _check(b" ".join(words[start:end])) == run["check"]:
            covered[start] += 1
            covered[end] -= 1
    stay = np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()
    kept = b" ".join([words[k] for k in stay] if len(stay) < len(words) else words)
    return len(words), len(words) - len(stay), kept.decode(errors="replace")


def remove_repeats(docs: DataFrame, window: int = 13, run: int = 2, held: int = HELD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``, one row for each row of ``docs``.

    Removed is every word inside a window of ``window`` words that also starts in a document
    with a smaller ``doc_id``, as the texts were given; ``kept`` are the other words joined
    by blanks. Repeats within one document, or among rows of one id, stay. Missing and blank
    texts, and texts shorter than a window, lose nothing, nor do rows without ``doc_id``,
    which other rows are not compared with either. Equal rows get equal results. Other
    columns are ignored; an empty table gives an empty table.

    Exact copies of a text do not travel: all their windows start in the first of them.
    """
    docs = docs.select("doc_id", "text")
    hashed = docs.filter("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    firsts = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = hashed.join(firsts, "h").filter("doc_id > first").select("doc_id").distinct()
    # An id with several texts is no copy as a whole.
    several = hashed.groupBy("doc_id").agg(F.count_distinct("h").alias("n")).filter("n > 1")
    copies = written(copies.join(several, "doc_id", "left_anti"), "copies")
    found = repeated_windows(rows_without(docs, copies, "doc_id"), window, run, held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts, runs = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            copies = batch.column(3).to_pylist()
            rows = []
            for text, of, copy in zip(texts, runs, copies, strict=True):
                n = len(text.split()) if copy else 0
                rows.append((n, n, "") if copy and n >= window else _kept(text, of or [], window))
            arrays = [
                batch.column(0),
                pa.array([row[0] for row in rows], pa.int64()),
                pa.array([row[1] for row in rows], pa.int64()),
                pa.array([row[2] for row in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    runs = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "check")).alias("runs"))
    known = copies.select("doc_id", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"), F.lit(True).alias("copy"))
    known = written(known.union(runs.withColumn("copy", F.lit(False))), "changes")
    # Texts that nothing is known of stay where they are.
    changed = key_filter(known, "doc_id")(F.col("doc_id"))
    touched = docs.filter(changed).join(known, "doc_id", "left")
    touched = touched.select("doc_id", "text", "runs", F.coalesce("copy", F.lit(False)).alias("copy"))
    none = F.lit(None).cast(runs.schema["runs"].dataType)
    rest = docs.filter(~changed).select("doc_id", "text", none.alias("runs"), F.lit(False).alias("copy"))
    everything = touched.union(rest)
    return everything.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
