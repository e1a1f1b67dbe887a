"""Words, shingles and their hashes, as numpy arrays over the bytes of a text.

Words are maximal runs of anything but the six ASCII white space characters. A-Z are
lower-cased by ``bytes.lower``, which touches nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

# Words are hashed as polynomials in an odd 64-bit base, whose inverse is needed as well.
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 19
# Rows of a slice.
_ROWS = 512


class Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            factors = np.full(max(n, 2 * len(self.up), 4096), _BASE, np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = pow(_BASE, -1, 2**64)
            self.down = np.multiply.accumulate(factors)
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, as byte offsets."""
    solid = np.zeros(len(text) + 2, np.int8)
    solid[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def _hashed(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_bounds(text)
    up, down = powers.upto(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    letters = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    np.cumsum(letters * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the start and the end of every word. Long texts go in pieces, which
    are cut between words."""
    if len(text) <= _PIECE:
        return _hashed(text, powers)
    spaces = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8)])
    parts, begin = [], 0
    while begin < len(text):
        k = np.searchsorted(spaces, begin + _PIECE)
        end = int(spaces[k]) if k < len(spaces) else len(text)
        hashes, starts, ends = _hashed(text[begin:end], powers if end - begin <= 2 * _PIECE else Powers())
        parts.append((hashes, starts + begin, ends + begin))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every ``n`` consecutive words, in order; of fewer words, one for all."""
    n = min(n, len(hashes)) or 1
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each text of a column, a missing one as empty."""
    return (value or b"" for value in column.cast(pa.binary()).to_pylist())


def as_strings(column: pa.Array) -> Iterator[str]:
    return (value or "" for value in column.to_pylist())


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds little more than what Spark sends at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def add_results(
    docs: DataFrame, carry: Sequence[str], make: Callable[[], Callable], results: str, text: str = "text"
) -> DataFrame:
    """The columns ``carry`` of every row and those named in ``results`` (DDL).

    ``make()`` runs once per task and returns a function from the column of some texts to a
    list with one Arrow array per result. Nothing is shuffled.
    """
    rest = [name for name in carry if name != text]
    rows = docs.select(text, *rest)
    kept = rows.schema.fields if text in carry else rows.schema.fields[1:]
    schema = T.StructType([*kept, *T.StructType.fromDDL(results).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = make()
        for batch in in_slices(batches):
            columns = batch.columns if len(kept) > len(rest) else batch.columns[1:]
            arrays = [*columns, *per_batch(batch.column(0))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    added = T.StructType.fromDDL(results).names
    return rows.mapInArrow(run, schema).select(*carry, *added)
