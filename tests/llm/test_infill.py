"""Fill-in-middle by piece tables: round trips, odd rows, the rule of the draw."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagesift.llm.infill import (
    ARRANGEMENTS,
    Piece,
    PieceTable,
    cut_document,
    drawn,
    fill_in_middle,
    restore,
    restored,
    unit_ends,
)

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, spm=80):
    """The contract, with string slices."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_text(rng):
    return "".join(rng.choices([" ", "\n", "\x0b", "a", "é", "\U0001f600", "<", "P", ">", "\x00", " ", "<S", " "], k=rng.randrange(40)))


def test_pieces_are_cut_permuted_and_put_back():
    table = PieceTable([b"abcdef", b"XY"], [Piece(0, 0, 6), Piece(1, 0, 2)])
    cut = table.cut(0, 2, 6, 7, 8)
    assert [bytes(v) for v in cut.views()] == [b"", b"ab", b"cdef", b"", b"X", b"Y", b""]
    parts = PieceTable.of(b"abcdef").cut(2, 4)
    assert [bytes(v) for v in parts.views()] == [b"ab", b"cd", b"ef"]
    order = (2, 0, 1)
    assert parts.arrange(order).spell() == b"efabcd"
    assert parts.arrange(order).arrange_back(order).pieces == parts.pieces
    assert parts.arrange(order).digest() == hashlib.sha256(b"efabcd").hexdigest()
    assert PieceTable.of(b"").cut(0, 0).spell() == b""


def test_units_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(500):
        text = random_text(rng)
        ends = [len(text[: m.end()].encode()) for m in UNIT.finditer(text)]
        assert unit_ends(text.encode()).tolist() == ends


def test_documents_equal_the_plain_version_and_come_back():
    rng, forms = random.Random(2), set()
    for n in range(2000):
        text = random_text(rng)
        rate = rng.choice([50, 100])
        units, form, table = cut_document(text.encode(), drawn(42, n), rate, 80)
        expected = plainly(n, text, rate)
        assert (units, form, table.spell().decode()) == (*expected[:2], expected[4])
        back = restored(table.spell(), form)
        assert back.spell().decode() == text and back.digest() == hashlib.sha256(text.encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", *ARRANGEMENTS}


def test_outputs_without_sentinels_are_refused():
    with pytest.raises(ValueError):
        restored(b"<P>a<S>b", "psm")
    with pytest.raises(ValueError):
        restored(b"<P>a<S>b<M>c", "spm")


def test_table_with_odd_rows(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.random()) for _ in range(60_000))
    texts = [(n, random_text(rng)) for n in range(60)]
    texts += [(3, None), (None, "a b c"), (None, "a b c"), (None, None), (70, ""), (71, " \n "), (72, "x <M> y")]
    texts += [(n, long) for n in range(80, 90)] + texts[:5]
    rows = [(*row, "c", "f", 1, 2) for row in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, form string, n int, pieces int")
    made = fill_in_middle(docs, carry=["output", "n"])
    assert {(r.carry_output, r.carry_n) for r in made.collect()} == {("c", 1)}
    got = sorted(map(repr, (tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())))
    assert got == sorted(repr((doc_id, *plainly(doc_id, text))) for doc_id, text in texts)
    wrong = made.filter(F.sha2("output", 256) != F.col("output_sha256")).count()
    assert wrong == 0
    back = sorted(map(repr, (tuple(r) for r in restore(made).select("carry_doc_id", "restored").collect())))
    assert back == sorted(repr((doc_id, text or "")) for doc_id, text in texts)
    assert restore(made).filter(F.sha2("restored", 256) != F.col("restored_sha256")).count() == 0
    spelled = made.filter("form != 'plain'").select("pieces", F.octet_length("output").alias("size")).collect()
    assert spelled and all(sum(p.length for p in r.pieces) == r["size"] and len(r.pieces) == 6 for r in spelled)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert fill_in_middle(docs).count() == 0 and restore(fill_in_middle(docs)).count() == 0


def test_rows_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = restore(fill_in_middle(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
