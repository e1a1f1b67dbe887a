"""Chat transcripts: read back, loss mask, blocks, odd rows, built-in functions only."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.llm.chat import escape, format_conversations, learned_text, read_back, unescape

SCHEMA = "conv_id bigint, turn int, role string, text string, formatted string, segments int, block int, parts int"
PIECES = ["<", "[", "\\", "/s>", "s>", "<s>", "</s>", "INST]", "[INST]", "[/INST]", "[TURN]", "[ROLE] ", "[TEXT]", " ", "ok", "\n", "é"]


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, 2, 3) for row in rows], SCHEMA)


def noise(rng):
    return "".join(rng.choices(PIECES, k=rng.randrange(9)))


def plainly(rows, learned=("assistant",)):
    """conv_id to its turns and what is learned; rows without an id one by one."""
    convs = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        key = ("row", k) if conv is None else conv
        convs.setdefault(key, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = []
    for key, turns in convs.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        out.append((None if isinstance(key, tuple) else key, turns, "".join(t for r, t in turns if r in learned)))
    return sorted(map(repr, out))


def made(df, **options):
    rows = format_conversations(df, **options).select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned")
    )
    return sorted(repr((r.conv_id, [(t.role, t.text) for t in r.turns], r.learned)) for r in rows.collect())


def test_transcript(spark):
    rows = [(1, 0, "system", "Be [INST]."), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c</s>"), (1, 4, "tool", "d")]
    row = format_conversations(table(spark, rows)).first()
    assert row.formatted == (
        "<s>[SYSTEM_PROMPT] Be [\\INST]. [/SYSTEM_PROMPT][INST] a[TURN]b [/INST] c<\\/s></s>[ROLE] tool[TEXT] d [/ROLE]"
    )
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["c<\\/s>"]


@pytest.mark.parametrize("block", [2, 512])
def test_random_conversations_come_back(spark, block):
    rng = random.Random(block)
    roles = ["user", "assistant", "assistant", "system", "tool", "[TEXT]", "", None]
    rows = [(rng.randrange(-3, 40), rng.randrange(-2, 9), rng.choice(roles), noise(rng)) for _ in range(600)]
    rows += rows[:30] + [(None, 1, "user", "u"), (None, 1, "user", "u"), (None, None, None, None)]
    rows += [(90, None, "assistant", "late"), (90, 5, "assistant", None), (91, 7, "assistant", ""), (92, 0, "user", "long " * 50_000)]
    assert made(table(spark, rows), block=block) == plainly(rows)


def test_blocks_change_nothing(spark):
    rng = random.Random(5)
    rows = [(k % 2, k, rng.choice(["user", "assistant"]), noise(rng)) for k in range(300)]
    df = table(spark, rows)
    texts = [{(r.conv_id, r.formatted) for r in format_conversations(df, block=b).collect()} for b in (1, 7, 512)]
    assert texts[0] == texts[1] == texts[2]
    segments = format_conversations(df, block=7).select(F.expr("aggregate(segments, '', (a, s) -> a || s.text) = formatted")).distinct()
    assert [r[0] for r in segments.collect()] == [True]


def test_other_roles_may_be_learned(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "tool", "b")]
    assert made(table(spark, rows), learned=("user", "tool")) == plainly(rows, ("user", "tool"))


def test_escaped_texts_have_no_control_strings(spark, values):
    rng = random.Random(9)
    texts = [noise(rng) for _ in range(1000)]
    escaped = values(escape, texts)
    assert not [t for t in escaped if any(c in t for c in ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[ROLE]", "[TEXT]"))]
    assert len(set(escaped)) == len(set(texts)) and values(unescape, escaped) == texts


def test_empty_table(spark):
    assert format_conversations(table(spark, [(1, 1, "a", "b")]).filter("false")).count() == 0


def test_plan_has_built_in_functions_only(spark):
    plan = format_conversations(table(spark, [(1, 1, "a", "b")]))._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Python", "Arrow", "Pandas", "ExistingRDD[") if word in plan.replace("Scan ExistingRDD", "")]
