"""Chat transcripts from rows of turns, with built-in expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
are merged into one marked run; runs are put together as segments, which say of every stretch
of the transcript whether the loss counts there. Control strings inside texts get a backslash after
their first character, so every control string of a transcript is a mark of the template, and
``read_back`` finds the turns again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings. Each begins with < or [ and has neither further on.
BEGIN = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("[SYSTEM_PROMPT] ", " [/SYSTEM_PROMPT]")}
#: Any other role is named: opening, between name and text, end.
NAMED = ("[ROLE] ", "[TEXT] ", " [/ROLE]")
#: Between the turns of a run.
NEXT = "[TURN]"

_WORDS = "INST|SYSTEM_PROMPT|ROLE|TEXT|TURN"
_CONTROL = rf"(?<=<)\\*(?=/?s>)|(?<=\[)\\*(?=/?(?:{_WORDS})\])"
_ESCAPED = rf"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?(?:{_WORDS})\])"
_RUN_END = r"(?<=</s>)|(?<=\[/INST\])|(?<=\[/SYSTEM_PROMPT\])|(?<=\[/ROLE\])"

SEGMENTS = "array<struct<text: string, loss: boolean>>"


def escape(text: Column) -> Column:
    """Text without control strings: those in it get a backslash after their first character,
    or one more if they had some."""
    return F.regexp_replace(text, _CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(NAMED[0]), escape(role), F.lit(NAMED[1]))
    for name, (begin, _) in MARKS.items():
        out = F.when(role == name, F.lit(begin)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(NAMED[2])
    for name, (_, end) in MARKS.items():
        out = F.when(role == name, F.lit(end)).otherwise(out)
    return out


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _inside(turns: Column, learned: Sequence[str]) -> Column:
    """The segments of sorted turns from the text of the first to the text of the last.

    Every turn looks at the one before it: if the role is the same it goes on with the run, else it
    closes that run and opens its own. That merges adjacent turns in one pass over the collected
    array, where a fold would copy what it has merged so far at every step.
    """

    def spelled(turn: Column, i: Column) -> Column:
        before, role = F.get(turns, i - 1)["role"], turn["role"]
        mark = F.when(i == 0, F.lit("")).when(before == role, F.lit(NEXT))
        mark = mark.otherwise(F.concat(_closing(before), _opening(role)))
        return F.array(_segment(mark, F.lit(False)), _segment(escape(turn["text"]), role.isin(*learned)))

    return F.flatten(F.transform(turns, spelled))


def _stitched(parts: Column) -> Column:
    """The segments of a whole transcript from those of its parts, in order."""

    def stitch(part: Column, k: Column) -> Column:
        before = F.get(parts, k - 1)["last"]
        start = F.concat(F.lit(BEGIN), _opening(part["first"]))
        joint = F.when(before == part["first"], F.lit(NEXT)).otherwise(F.concat(_closing(before), _opening(part["first"])))
        mark = _segment(F.when(k == 0, start).otherwise(joint), F.lit(False))
        return F.concat(F.array(mark), part["segments"])

    end = _segment(_closing(F.element_at(parts, -1)["last"]), F.lit(False))
    return F.concat(F.flatten(F.transform(parts, stitch)), F.array(end))


def _part(turns: Column, learned: Sequence[str]) -> Column:
    return F.struct(
        F.get(turns, F.lit(0))["role"].alias("first"),
        F.element_at(turns, -1)["role"].alias("last"),
        _inside(turns, learned).alias("segments"),
    )


def format_conversations(
    rows: DataFrame, learned: Sequence[str] = ("assistant",), block: int = 512
) -> DataFrame:
    """``conv_id, formatted, segments``, one row for each conversation.

    ``formatted`` is the transcript, ``segments`` the same in pieces with the loss mask: the
    loss counts in the texts of the roles in ``learned`` and nowhere else, not in their marks.

    Turns are ordered by ``turn`` (NULL first), ties by role and text; repeated rows are repeated
    turns. NULL texts and roles are empty ones. Rows without ``conv_id`` belong together with
    nothing: each is a conversation of its own, with a NULL id. Roles other than user, assistant and
    system are spelled out. An empty table gives an empty table. Other columns are ignored.

    Conversations with turn numbers of ``block`` and more (or below 0) are formatted block by
    block, in tasks of their own, and only the finished blocks come together in the row that the
    transcript is. All others are collected once. Which ones are long is told by ids alone.
    """
    clean = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = F.struct("turn", "role", "text")
    sorted_turns = F.sort_array(F.collect_list(turn))
    long = clean.filter((F.col("turn") >= block) | (F.col("turn") < 0)).select("conv_id").distinct()

    alone = clean.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    short = clean.filter("conv_id is not null").join(long, "conv_id", "left_anti")
    short = short.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    whole = short.unionByName(alone).select("conv_id", F.array(_part(F.col("turns"), learned)).alias("parts"))

    number = F.floor(F.col("turn") / block).alias("block")
    blocks = clean.join(long, "conv_id", "left_semi").groupBy("conv_id", number).agg(sorted_turns.alias("turns"))
    blocks = blocks.select("conv_id", "block", _part(F.col("turns"), learned).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "part")))
    joined = blocks.groupBy("conv_id").agg(F.transform(ordered, lambda b: b["part"]).alias("parts"))

    out = whole.unionByName(joined).select("conv_id", _stitched(F.col("parts")).alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", formatted.alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a transcript: ``array<struct<role, text>>``, from its marks alone."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))
    runs = F.filter(F.split(body, _RUN_END), lambda run: run != "")

    def turns(role: Column, texts: Column) -> Column:
        each = F.split(texts, r"\[TURN\]", -1)
        return F.transform(each, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def read(run: Column) -> Column:
        # A named run: [ROLE] name[TEXT] texts [/ROLE]
        inner = _without(run, len(NAMED[0]), len(NAMED[2]))
        name = F.substring_index(inner, NAMED[1], 1)
        out = turns(unescape(name), F.substring(inner, F.length(name) + len(NAMED[1]) + 1, F.length(inner)))
        for role, (begin, end) in MARKS.items():
            out = F.when(run.endswith(end), turns(F.lit(role), _without(run, len(begin), len(end)))).otherwise(out)
        return out

    return F.flatten(F.transform(runs, read))


def _without(text: Column, begin: int, end: int) -> Column:
    return F.substring(text, F.lit(begin + 1), F.length(text) - begin - end)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
