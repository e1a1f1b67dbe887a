"""Fill-in-middle texts made with a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over two buffers that never
change: its text and the sentinels. Cutting splits a descriptor, an arrangement permutes the
descriptors, the inverse permutation puts them back, and digests are fed descriptor by
descriptor. Text is copied once, when the arranged document is written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm.text import as_bytes, in_slices, word_bounds

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARKS = PREFIX + SUFFIX + MIDDLE
#: The order in which a form shows (prefix, middle, suffix, <P>, <S>, <M>).
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}

_PIECES = "array<struct<buffer: int, start: bigint, length: bigint>>"
_SPAN = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers. No method copies or changes a buffer."""

    def __init__(self, buffers: Sequence[bytes], pieces: Sequence[Piece]) -> None:
        self.buffers, self.pieces = [memoryview(b) for b in buffers], list(pieces)

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls([text, _MARKS], [Piece(0, 0, len(text))])

    def cut(self, *places: int) -> PieceTable:
        """Descriptors that end at each of the ascending ``places``; parts may be empty."""
        out, done, ends = [], 0, iter(places)
        at = next(ends, None)
        for buffer, start, length in self.pieces:
            begin = 0
            while at is not None and at <= done + length:
                out.append(Piece(buffer, start + begin, at - done - begin))
                begin, at = at - done, next(ends, None)
            out.append(Piece(buffer, start + begin, length - begin))
            done += length
        return PieceTable(self.buffers, out)

    def arrange(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def arrange_back(self, order: Sequence[int]) -> PieceTable:
        """What ``arrange(order)`` was made from."""
        return self.arrange(np.argsort(order).tolist())

    def views(self) -> Iterator[memoryview]:
        return (self.buffers[b][start : start + length] for b, start, length in self.pieces)

    def digest(self) -> str:
        """SHA-256 of the text that the descriptors spell."""
        whole = hashlib.sha256()
        for view in self.views():
            whole.update(view)
        return whole.hexdigest()

    def spell(self) -> bytes:
        return b"".join(self.views())


def unit_ends(text: bytes) -> np.ndarray:
    """Where the units of a text end: a word with the white space before it, and the rest."""
    ends = word_bounds(text)[1]
    return np.append(ends, len(text)) if len(text) and (not len(ends) or ends[-1] < len(text)) else ends


def code_points(text: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut_document(text: bytes, numbers: Sequence[int], rate: int, spm: int) -> tuple[int, str, PieceTable]:
    """The number of units, the form, and the arranged document."""
    h1, h2, h3, h4 = numbers
    whole, ends = PieceTable.of(text), unit_ends(text)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", whole
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    places = [int(ends[k - 1]) if k else 0 for k in (first, last)]
    parts = whole.cut(*places)
    parts.pieces += [Piece(1, 0, 3), Piece(1, 3, 3), Piece(1, 6, 3)]
    form = "spm" if h4 % 100 < spm else "psm"
    return len(ends), form, parts.arrange(ARRANGEMENTS[form])


def restored(output: bytes, form: str | None) -> PieceTable:
    """The document that an output was made from, as descriptors over the output."""
    whole = PieceTable([output], [Piece(0, 0, len(output))])
    if form not in ARRANGEMENTS:
        return whole
    # A text with a sentinel stays plain, so the first of each is the one that was put in.
    marks = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    second = output.find(marks[1], 3)
    third = output.find(MIDDLE, second + 3)
    if not output.startswith(marks[0]) or second < 0 or third < 0:
        raise ValueError(f"No output of form '{form}'")
    parts = whole.cut(3, second, second + 3, third, third + 3)
    back = parts.arrange_back(ARRANGEMENTS[form])
    return PieceTable(back.buffers, [back.pieces[k] for k in (0, 1, 2)])


def _arranged(
    batches: Iterator[pa.RecordBatch], schema: list[str], seed: int, rate: int, spm: int
) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        rows = []
        for text, doc_id in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            n, form, table = cut_document(text, drawn(seed, doc_id), rate, spm)
            chars = [None, None]
            if form != "plain":
                parts = PieceTable(table.buffers, [table.arrange_back(ARRANGEMENTS[form]).pieces[k] for k in (0, 1)])
                chars = [code_points(view) for view in parts.views()]
            rows.append((n, form, *chars, [p._asdict() for p in table.pieces], table.spell(), table.digest()))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), _SPAN, pa.binary(), pa.string())
        made = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
        made[5] = made[5].cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=schema)


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256`` and the
    columns in ``carry`` as ``carry_<name>``, one row for each row of ``docs``.

    ``n`` counts the units of the text: words, each with the ASCII white space before it, and
    white space at the end. Two cuts between units, drawn from ``seed`` and ``doc_id`` alone,
    make prefix, middle and suffix. ``rate`` of 100 documents are rearranged, ``spm`` of 100 of
    those suffix first; the others stay ``plain``, and so does every text that is empty or holds a
    sentinel, which makes each output readable back (``restore``). ``pieces`` are the descriptors
    of the output: buffer 0 is the text, 1 the sentinels, in bytes.

    A NULL text is an empty one. Rows without ``doc_id`` draw as if it were an empty string. Equal
    rows get equal results. An empty table gives an empty table. Columns that are not named are
    ignored, whatever their names. Rows are independent: nothing is shuffled.
    """
    kept = [F.col(name).alias(f"carry_{name}") for name in carry]
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *kept)
    made = T.StructType.fromDDL(
        f"n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {_PIECES}, output string, "
        "output_sha256 string"
    )
    schema = T.StructType([*rows.schema.fields[1:], *made.fields])
    run = partial(_arranged, schema=schema.names, seed=seed, rate=rate, spm=spm)
    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", *made.names, *[f"carry_{name}" for name in carry])


def _put_back(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        tables = [
            restored(text, form)
            for text, form in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True)
        ]
        texts = pa.array([table.spell() for table in tables], pa.binary()).cast(pa.string())
        digests = pa.array([table.digest() for table in tables], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], texts, digests], names=schema)


def restore(
    made: DataFrame, output: str | Column = "output", form: str | Column = "form", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``restored, restored_sha256`` and the columns in ``carry`` as ``carry_<name>``: the text
    that an output was made from, read from nothing but the output and its form. A NULL output is
    an empty text, a NULL or unknown form is ``plain``; an output that lacks its sentinels raises.
    """
    pick = [c if isinstance(c, Column) else F.col(c) for c in (output, form)]
    kept = [F.col(name).alias(f"carry_{name}") for name in carry]
    rows = made.select(pick[0].alias("output"), pick[1].alias("form"), *kept)
    schema = T.StructType(
        [*rows.schema.fields[2:], T.StructField("restored", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    )
    return rows.mapInArrow(partial(_put_back, schema=schema.names), schema)
