"""Page range expressions such as ``1,3-5,8-`` as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import strip

# One part: a number, ``a-b``, ``a-`` or ``-b``; blanks around numbers are fine.
_PART = r"^\s*(?:\+?\d+\s*-?|-\s*\+?\d+|\+?\d+\s*-\s*\+?\d+)\s*$"


def check_spec(spec: str | None) -> None:
    """Raise ``ValueError`` for a literal that names no pages at all, as early as possible."""
    if not spec or spec.strip().lower() == "all":
        return
    for part in spec.split(","):
        if part.strip() and not re.match(_PART, part):
            raise ValueError(f"Bad page range '{part.strip()}' in '{spec}'")


def bad_spec_reason(spec: Column) -> Column:
    """NULL for a usable expression, else which part is wrong."""
    bad = F.filter(F.split(spec, ","), lambda p: (strip(p) != "") & ~p.rlike(_PART))
    everything = F.lower(strip(spec)) == "all"
    return F.when(
        (F.size(bad) > 0) & ~everything, F.concat(F.lit("bad page range: "), strip(F.get(bad, F.lit(0))))
    )


def page_range(spec: Column, total: Column) -> Column:
    """0-based page indices named by ``spec``: in the order named, each once, all in range.

    Both ends are clamped before ``sequence`` builds anything, so ``1-999999999``
    costs no more than the document is long. A bad expression gives NULL.
    """
    total = total.cast("int")
    no_pages = F.array().cast("array<int>")
    every_page = F.when(total > 0, F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1)).otherwise(no_pages)

    def span(part: Column) -> Column:
        low = F.regexp_extract(part, r"^\s*\+?(\d*)", 1)
        high = F.regexp_extract(part, r"\+?(\d*)\s*$", 1)
        dashed = part.contains("-")
        start = F.when(low == "", F.lit(1)).otherwise(_clamp(low, total))
        stop = F.when(~dashed, start).when(high == "", total).otherwise(_clamp(high, total))
        first = F.greatest(start, F.lit(1))
        last = F.least(stop, total)
        return F.when(first <= last, F.sequence(first - 1, F.greatest(first, last) - 1)).otherwise(no_pages)

    parts = F.filter(F.split(spec, ","), lambda p: strip(p) != "")
    named = F.array_distinct(F.flatten(F.transform(parts, span)))
    return (
        F.when(F.coalesce(spec, F.lit("")) == "", every_page)
        .when(F.lower(strip(spec)) == "all", every_page)
        .when(bad_spec_reason(spec).isNotNull(), F.lit(None))
        .otherwise(named)
    )


def _clamp(digits: Column, total: Column) -> Column:
    """A digit string as a number between 0 and one past the last page."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(short) > 9, F.lit(999999999)).otherwise(short.try_cast("int"))
    return F.least(number, total + 1)
