"""CSS selection as set algebra over node numbers.

A selector becomes, per step, the array of numbers of the matching nodes, of which those
stay, in document order, that stand in the asked relation to the step before. That is
linear in the page but for sorting, where testing every node against every possible
ancestor or sibling would be quadratic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.functions.nodes import at, inside, span
from pagesift.functions.text import clean_ws

MARKUP_LIMIT = 500

_IDENT = r"-?[_a-zA-Z\u0080-￿][-\w\u0080-￿]*"
_SIMPLE = re.compile(
    rf"""(?P<any>\*)|(?P<type>{_IDENT})|\#(?P<id>[-\w\u0080-￿]+)|\.(?P<cls>{_IDENT})
    |\[\s*(?P<attr>[-\w:]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[-\w]+))\s*)?\]
    |:(?P<pseudo>first-child|last-child)
    |:nth-child\(\s*(?P<nth>odd|even|[-+]?\d*n(?:\s*[-+]\s*\d+)?|[-+]?\d+)\s*\)
    |:not\((?P<not>(?:[^()"']|"[^"]*"|'[^']*')*)\)""",
    re.X | re.I,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")

Predicate = Callable[[Column], Column]


def parse_selector(css: str) -> list[list[tuple[str, Predicate]]]:
    """Comma branches, each a list of (combinator, node predicate). Raises ``ValueError``."""
    branches, steps, at = [], [], 0
    text, combinator = css.strip(), ""
    while True:
        predicate, at = _compound(text, at, css)
        steps.append((combinator, predicate))
        comma = re.compile(r"\s*,\s*").match(text, at)
        if at == len(text) or comma:
            branches.append(steps)
            if at == len(text):
                return branches
            steps, combinator, at = [], "", comma.end()
            continue
        step = _COMBINATOR.match(text, at)
        if not step:
            raise ValueError(f"Unsupported CSS selector '{css}' at '{text[at:]}'")
        combinator, at = step[1] or " ", step.end()


def hits_of(nodes: Column, spelled: Column, css: str, clean: bool = True) -> Column:
    """``array<struct<index, tag, content, html>>`` for the elements a selector hits.

    What a hit shows is cut from the page's text and markup (``spelled``) by offset, so it costs
    what it is long, however deep elements nest.
    """
    branches = [_branch_ids(nodes, steps) for steps in parse_selector(css)]
    ids = branches[0]
    for other in branches[1:]:
        ids = F.array_union(ids, other)
    if len(branches) > 1:
        ids = F.array_sort(ids)

    def cut(name: str, begin: Column, end: Column) -> Column:
        return F.substring(spelled[name], begin + 1, end - begin).cast("string")

    def hit(node_id: Column, index: Column) -> Column:
        node = at(nodes, node_id)
        text = cut("text", F.get(spelled["text_at"], node_id), F.get(spelled["text_at"], node["last"] + 1))
        # A selected script or style shows its own string.
        own = F.when(node["last"] > node_id, at(nodes, node_id + 1)["text"])
        content = F.when(node["tag"].isin("script", "style"), F.coalesce(own, F.lit(""))).otherwise(text)
        begin = F.get(spelled["begins"], node_id)
        # A character has at most four bytes; one that is cut in two lies behind the limit.
        end = F.least(F.get(spelled["ends"], node_id), begin + 4 * MARKUP_LIMIT)
        return F.struct(
            index.alias("index"),
            node["tag"].alias("tag"),
            (clean_ws(content) if clean else content).alias("content"),
            F.substring(cut("markup", begin, end), 1, MARKUP_LIMIT).alias("html"),
        )

    return F.transform(ids, hit)


def _branch_ids(nodes: Column, steps: list[tuple[str, Predicate]]) -> Column:
    found = None
    for combinator, predicate in steps:
        matching = F.transform(F.filter(nodes, predicate), lambda n: n["id"])
        found = matching if found is None else _related(nodes, found, matching, combinator)
    return found


def _related(nodes: Column, ids: Column, matching: Column, combinator: str) -> Column:
    """Those of ``matching`` that stand in the given relation to any of ``ids``.

    Both are sorted, and each relation is looked up in an array over all nodes, so no
    node is met more than a few times however elements nest or repeat.
    """
    if combinator == "+":
        following = F.transform(ids, lambda i: at(nodes, i)["next"])
        return F.array_intersect(matching, F.array_compact(following))
    if combinator == " ":
        spans = F.transform(let(ids, lambda i: _outermost(nodes, i)), lambda i: inside(at(nodes, i)))
        return F.array_intersect(matching, F.flatten(spans))
    if combinator == ">":
        marks = _over_nodes(F.transform(ids, lambda i: _entry(i + 1, i)))
        found = lambda m, i: F.get(m, at(nodes, i)["parent"] + 1).isNotNull()
    else:
        marks = _over_nodes(let(_by_parent(nodes, ids), _first_of_parent))
        found = lambda m, i: F.coalesce(F.get(m, at(nodes, i)["parent"] + 1) < i, F.lit(False))
    return let(marks, lambda m: F.filter(matching, lambda i: found(m, i)))


def _outermost(nodes: Column, ids: Column) -> Column:
    """Those of sorted ``ids`` inside no other: all that begin earlier have ended, which
    is so if that many ends lie before."""
    ends = F.array_sort(F.transform(ids, lambda i: at(nodes, i)["last"]))
    return let(ends, lambda e: F.filter(ids, lambda i, k: (k == 0) | (F.get(e, k - 1) < i)))


def _entry(place: Column, value: Column) -> Column:
    return F.struct(place.alias("place"), value.alias("value"))


def _by_parent(nodes: Column, ids: Column) -> Column:
    # Parents are counted from -1, the page itself.
    return F.array_sort(F.transform(ids, lambda i: _entry(at(nodes, i)["parent"] + 1, i)))


def _first_of_parent(entries: Column) -> Column:
    def is_first(entry: Column, k: Column) -> Column:
        return (k == 0) | (F.get(entries, k - 1)["place"] != entry["place"])

    return F.filter(entries, is_first)


def _over_nodes(entries: Column) -> Column:
    """An array with each value at its place and NULL elsewhere, from entries sorted by place."""

    def filled(sorted_entries: Column) -> Column:
        def stretch(entry: Column, k: Column) -> Column:
            before = F.when(k == 0, -1).otherwise(F.get(sorted_entries, k - 1)["place"])
            gap = F.array_repeat(F.lit(None).cast("int"), entry["place"] - before - 1)
            return F.concat(gap, F.array(entry["value"]))

        return F.flatten(F.transform(sorted_entries, stretch))

    return let(entries, filled)


def _compound(text: str, at: int, css: str) -> tuple[Predicate, int]:
    tests: list[Predicate] = []
    while simple := _SIMPLE.match(text, at):
        if tests and (simple["type"] or simple["any"]):
            break
        tests.append(_test(simple, css))
        at = simple.end()
    if not tests:
        raise ValueError(f"Unsupported CSS selector '{css}' at '{text[at:]}'")

    def all_tests(node: Column) -> Column:
        result = node["pos"].isNotNull()
        for test in tests:
            result = result & test(node)
        return result

    return all_tests, at


def _test(simple: re.Match, css: str) -> Predicate:
    if simple["any"]:
        return lambda n: F.lit(True)
    if simple["type"]:
        return lambda n: n["tag"] == simple["type"].lower()
    if simple["id"]:
        return lambda n: F.coalesce(n["attrs"].getItem("id") == simple["id"], F.lit(False))
    if simple["cls"]:
        return lambda n: _has_word(n["attrs"].getItem("class"), simple["cls"])
    if simple["attr"]:
        return _attribute_test(simple)
    if simple["pseudo"]:
        if simple["pseudo"].lower() == "first-child":
            return lambda n: n["pos"] == 1
        return lambda n: n["next"].isNull()
    if simple["nth"]:
        return _nth_test(simple["nth"].lower().replace(" ", ""))
    inner, end = _compound(simple["not"].strip(), 0, css)
    if end != len(simple["not"].strip()):
        raise ValueError(f"Unsupported CSS selector '{css}': :not() takes one simple selector")
    return lambda n: ~inner(n)


def _has_word(value: Column, word: str) -> Column:
    return F.coalesce(F.array_contains(F.split(value, r"[ \t\n\r\f]+"), word), F.lit(False))


def _attribute_test(simple: re.Match) -> Predicate:
    name, op = simple["attr"].lower(), simple["op"]
    wanted = next((simple[g] for g in ("dq", "sq", "bare") if simple[g] is not None), None)

    def test(node: Column) -> Column:
        value = node["attrs"].getItem(name)
        if op is None:
            return value.isNotNull()
        if op != "=" and wanted == "":
            return F.lit(False)
        matched = {
            "=": lambda: value == wanted,
            "^=": lambda: value.startswith(wanted),
            "$=": lambda: value.endswith(wanted),
            "*=": lambda: value.contains(wanted),
            "~=": lambda: _has_word(value, wanted),
        }[op]()
        return F.coalesce(matched, F.lit(False))

    return test


def _nth_test(formula: str) -> Predicate:
    formula = {"odd": "2n+1", "even": "2n"}.get(formula, formula)
    if "n" not in formula:
        return lambda n: n["pos"] == int(formula)
    step_text, offset_text = formula.split("n")
    step = int(step_text + "1") if step_text in ("", "+", "-") else int(step_text)
    offset = int(offset_text or 0)
    if step == 0:
        return lambda n: n["pos"] == offset
    size, sign = abs(step), 1 if step > 0 else -1
    return lambda n: (F.pmod(n["pos"] - offset, F.lit(size)) == 0) & ((n["pos"] - offset) * sign >= 0)
