"""Phrase mining: word sequences counted in HAT-tries, collocations scored exactly.

Every task counts the words, pairs and triples of its texts in one trie of word numbers per
language, whose leaves are hash containers that burst when they grow too large. When the
tries of a task hold too many entries, whole subtrees leave the task as sorted runs, packed
by prefix partition. Spark brings the runs of a partition together, where they are merged.

The prefix is language, first and second word, so that a frequent first word is spread; the
third word deals every prefix out over ``_SPREAD`` partitions more, so that a frequent pair is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.text import as_bytes, in_slices, mix
from pagesift.plans.scratch import written

#: The most words of a phrase. Three ids of 21 bits make a key.
LONGEST = 3
_BITS = 21
_LAST = (1 << _BITS) - 1

# What a task holds at most: sequences, words, and entries of one container.
ENTRIES, WORDS, BURST = 2_000_000, 1 << 20, 1 << 15
_TOKENS = 1 << 16
_PIECE = 1 << 20
_SPREAD = 16
#: Shares of a language's candidates that are ranked by themselves first.
_SHARES = 64
#: Prefix partitions for each of Spark's.
_PARTS = 8

# Ends of pieces; the byte for them is in no UTF-8 text.
_END = b"\xff"
_ENDS = bytes(0xFF if c in b".,;:!?\n\v\f\r" else c for c in range(256))


class _Words(dict):
    """Word to number, the end of a piece to 0, and for each number its spelling and rank."""

    def __init__(self) -> None:
        super().__init__({_END: 0})
        self.spelled, self.sorted = [b""], []
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.spelled)
        self.spelled.append(word)
        return n

    def ranks(self) -> np.ndarray:
        """The place of each number in the order of the words, 0 for none."""
        # Only words that are new since the last time are out of order.
        self.sorted += self.spelled[len(self.sorted) + 1 :]
        self.sorted.sort()
        ranks = np.zeros(len(self.spelled), np.int64)
        numbers = np.fromiter(map(self.__getitem__, self.sorted), np.int64, len(self.sorted))
        ranks[numbers] = np.arange(1, len(numbers) + 1)
        return ranks

    def hashed(self) -> np.ndarray:
        new = self.spelled[len(self.hashes) :]
        self.hashes = np.append(self.hashes, np.fromiter(map(zlib.crc32, new), np.uint64, len(new)))
        return self.hashes


class HatTrie:
    """Counts of sequences of one to three words, whose numbers make a key.

    The leaves are hash containers, from key to count. Each is the subtree of a range of first
    words (a hybrid container) or, below one first word, of a range of second words.
    A container with more than ``burst`` entries bursts into two at the word in its middle.
    Only a pair of words, which holds one entry per third word, cannot burst.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.words, self.burst, self.n_words = _Words(), burst, 0
        #: The least key of each container, ascending.
        self.bounds, self.containers = [0], [Counter()]

    @property
    def entries(self) -> int:
        return sum(map(len, self.containers))

    def count(self, tokens: list[bytes], old: int = 0) -> None:
        """Count all sequences that end behind the first ``old`` tokens."""
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        keys = [np.empty(0, np.int64)]
        for n in range(1, LONGEST + 1):
            start = max(old - n + 1, 0)
            if len(ids) - start < n:
                break
            columns = [ids[start + k : len(ids) - n + 1 + k] for k in range(n)]
            inside = np.logical_and.reduce([c > 0 for c in columns])
            key = sum(c[inside] << (_BITS * (LONGEST - 1 - k)) for k, c in enumerate(columns))
            self.n_words += len(key) if n == 1 else 0
            keys.append(key)
        keys = np.sort(np.concatenate(keys))
        places = [*np.searchsorted(keys, self.bounds).tolist(), len(keys)]
        listed = keys.tolist()
        full = []
        for k, container in enumerate(self.containers):
            if places[k] < places[k + 1]:
                container.update(listed[places[k] : places[k + 1]])
                if len(container) > self.burst:
                    full.append(k)
        for k in reversed(full):
            self._burst(k)

    def _burst(self, k: int) -> None:
        container = self.containers[k]
        keys = np.sort(np.fromiter(container.keys(), np.int64, len(container)))
        for bits in (2 * _BITS, _BITS):
            words = keys >> bits
            if words[0] == words[-1]:
                continue
            # The first key of the word in the middle, or of the next one if that begins the container.
            middle = words[len(words) // 2]
            middle = middle if middle > words[0] else words[np.searchsorted(words, middle, "right")]
            bound = int(middle) << bits
            upper = Counter({key: n for key, n in container.items() if key >= bound})
            lower = Counter({key: n for key, n in container.items() if key < bound})
            self.containers[k : k + 1] = [lower, upper]
            self.bounds.insert(k + 1, bound)
            for part in (k + 1, k):
                if len(self.containers[part]) > self.burst:
                    self._burst(part)
            return

    def take(self, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of whole subtrees with ``entries`` entries or more, which are empty then:
        those of the newest words, which are seldom met again. The trie keeps its shape."""
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in reversed(range(len(self.containers))):
            if entries <= 0:
                break
            taken, self.containers[k] = self.containers[k], Counter()
            keys.append(np.fromiter(taken.keys(), np.int64, len(taken)))
            counts.append(np.fromiter(taken.values(), np.int64, len(taken)))
            entries -= len(taken)
        return np.concatenate(keys), np.concatenate(counts)

    def forget(self) -> None:
        """Start over with new numbers, once everything has been taken."""
        self.words, self.bounds, self.containers = _Words(), [0], [Counter()]


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with marks between its pieces and one at its end.
    Long texts come in several lists, cut between words."""
    marked = text.lower().translate(_ENDS)
    begin = 0
    while begin < len(marked):
        end = begin + _PIECE
        cuts = [at for at in (marked.find(c, end) for c in (b" ", b"\t", _END)) if at >= 0]
        end = len(marked) if end >= len(marked) or not cuts else min(cuts)
        yield marked[begin:end].replace(_END, b" \xff ").split()
        begin = end
    yield [_END]


def _groups(heads: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of every stretch of equal values."""
    starts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    ends = np.append(starts[1:], len(heads))
    return zip(heads[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)


def _runs(trie: HatTrie, entries: int, lang: str, parts: int) -> list[tuple[int, str, bytes]]:
    """Subtrees as sorted runs, one for each prefix partition: part, lang, packed lines of a
    phrase and its count."""
    keys, counts = trie.take(entries)
    if not len(keys):
        return []
    ranks, hashes = trie.words.ranks(), trie.words.hashed()
    ids = [keys >> 2 * _BITS, keys >> _BITS & _LAST, keys & _LAST]
    prefix = mix(hashes[ids[0]] << np.uint64(32) | hashes[ids[1]]) + hashes[ids[2]] % np.uint64(_SPREAD)
    part = (mix(prefix) % np.uint64(parts)).astype(np.uint32)
    order = np.argsort(ranks[ids[0]] << 2 * _BITS | ranks[ids[1]] << _BITS | ranks[ids[2]])
    order = order[np.argsort(part[order], kind="stable")]
    words = pa.array(trie.words.spelled, pa.large_binary())
    space, tab, end, nothing = (pa.scalar(mark, pa.large_binary()) for mark in (b" ", b"\t", b"\n", b""))
    spaces = pc.if_else(pa.array(np.arange(len(words)) > 0), space, nothing)
    further = pc.binary_join_element_wise(spaces, words, nothing)
    a, b, c = (column[order] for column in ids)
    shown = pa.array(counts[order]).cast(pa.large_string()).cast(pa.large_binary())
    lines = pc.binary_join_element_wise(words.take(a), further.take(b), further.take(c), tab, shown, end, nothing)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)
    spelled, pack = memoryview(lines.buffers()[2]), zstandard.ZstdCompressor(level=1).compress
    # The end of the last line of a run is left out.
    return [(p, lang, pack(spelled[offsets[s] : offsets[e] - 1])) for p, s, e in _groups(part[order])]


_RUN = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("run", pa.binary())])


def _counted(batches: Iterator[pa.RecordBatch], parts: int, entries: int) -> Iterator[pa.RecordBatch]:
    tries: dict[str, HatTrie] = {}

    def batch_of(runs: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
        columns = zip(zip(*runs, strict=True), _RUN.types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], schema=_RUN)

    def spill(share: float) -> Iterator[pa.RecordBatch]:
        for lang, trie in tries.items():
            if runs := _runs(trie, int(np.ceil(share * trie.entries)), lang, parts):
                yield batch_of(runs)

    def room() -> Iterator[pa.RecordBatch]:
        if sum(len(t.words) for t in tries.values()) > WORDS:
            yield from spill(1)
            for trie in tries.values():
                trie.forget()
        elif sum(t.entries for t in tries.values()) > entries:
            yield from spill(0.5)

    for batch in in_slices(batches):
        texts: dict[str, list[bytes]] = {}
        for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, group in texts.items():
            trie = tries.setdefault(lang, HatTrie())
            tokens, old = [], 0
            for text in group:
                for some in tokens_of(text):
                    tokens += some
                    if len(tokens) >= _TOKENS:
                        trie.count(tokens, old)
                        tokens = tokens[1 - LONGEST :]
                        old = len(tokens)
                        yield from room()
            trie.count(tokens, old)
            yield from room()
    yield from spill(1)
    # The number of words goes with the empty phrase.
    pack = zstandard.ZstdCompressor(level=1).compress
    if tries:
        yield batch_of([(0, lang, pack(b"\t%d" % trie.n_words)) for lang, trie in tries.items()])


def merge_runs(runs: list[bytes], least: int) -> tuple[list[bytes], list[int]]:
    """Phrases of sorted runs with ``least`` occurrences or more, and the empty one.

    The sort takes every run for one of its own and merges them; lines of one phrase begin
    alike, so they end up next to each other.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    lines = [line for run in runs for line in unpack(run).split(b"\n")]
    lines.sort()
    phrases, counts, last, total = [], [], None, 0
    for line in chain(lines, (b"",)):
        phrase, tab, n = line.rpartition(b"\t")
        if phrase == last and tab:
            total += int(n)
            continue
        if last is not None and (total >= least or not last):
            phrases.append(last)
            counts.append(total)
        last, total = phrase, int(n or 0)
    return phrases, counts


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (_, lang), same in groupby(rows, key=lambda row: row[:2]):
        phrases, counts = merge_runs([row[2] for row in same], least)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
            names=["lang", "phrase", "f"],
        )


def count_phrases(docs: DataFrame, least: int = 10, entries: int = ENTRIES) -> DataFrame:
    """``lang, phrase, f``: sequences of one to three words with ``least`` occurrences or more,
    and under the empty phrase the number of all words of the language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends and those into
    words at spaces and tabs; sequences lie within a piece. ``entries`` bounds what a task holds.
    """
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    counted = partial(_counted, parts=_PARTS * shuffles, entries=entries)
    runs = texts.mapInArrow(counted, "part int, lang string, run binary")
    dealt = runs.repartition(shuffles, "part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(partial(_merged, least=least), "lang string, phrase string, f bigint")


def mine_phrases(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, entries: int = ENTRIES
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` collocations of each language.

    Candidates are phrases of two and three words with ``a >= least`` occurrences. Cut after
    its first ``k`` words a candidate has the score ``floor(1000000 a a / (l r))``, where ``l``
    and ``r`` are the occurrences of its two parts; the cut with the lowest score counts, then the
    first. Candidates that lie in a longer one with ``100 f(longer) >= share a`` are dropped.
    Ranks go by score, ``a`` (both descending) and phrase in UTF-8 order, so there are no ties.

    ``n`` is the number of all words of the language. All numbers are exact: scores are made of
    decimals of 38 digits. NULL texts are empty, NULL languages are ``und``. Repeated rows count
    repeatedly, ids play no part. An empty table, or one without candidates, gives an empty
    table. Other columns of ``docs`` are ignored, whatever their names.
    """
    counts = written(count_phrases(docs, least, entries), "phrase-counts")
    words = F.split("phrase", " ")
    cands = counts.filter(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1),
        lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("left"), joined(k + 1, F.size("w")).alias("right")),
    )
    cut = cands.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cut.withColumn(
        "score",
        F.expr(
            "(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000)"
            " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
        ),
    )
    lowest = F.min(F.struct("score", "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(lowest.alias("best"))

    inside = cands.filter(F.size("w") == LONGEST).select(
        "lang", F.explode(F.array(joined(F.lit(1), F.lit(2)), joined(F.lit(2), F.lit(2)))).alias("phrase"), "a"
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # The first of each share of a language before the first of all.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(_SHARES)))
    place = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    kept = kept.withColumn("place", place).filter(F.col("place") <= top).drop("share", "place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
