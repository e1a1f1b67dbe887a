"""Expressions over a page's node array (see ``sources.html``). All work in the row.

Parts of a page are passed around as node numbers. ``slice`` would be shorter, but in a
lambda it walks the whole array on every call; numbers cost what the part is long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import strip


def span(first: Column, last: Column) -> Column:
    """The numbers ``first`` to ``last``, none if ``last`` is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def inside(node: Column) -> Column:
    """Numbers of the descendants of a node, in document order."""
    return span(node["id"] + 1, node["last"])


def at(nodes: Column, number: Column) -> Column:
    """The node with a number."""
    return F.get(nodes, number)


def with_tag(nodes: Column, *tags: str) -> Column:
    """The elements of a page with one of the given names."""
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def ids_with_tag(nodes: Column, ids: Column, *tags: str) -> Column:
    """Those of the numbered nodes that have one of the given names."""
    return F.filter(ids, lambda i: at(nodes, i)["tag"].isin(*tags))


def not_noise(node: Column) -> Column:
    """True for nodes outside style, noscript and iframe."""
    return ~node["noise"]


def strings_in(nodes: Column, node: Column) -> Column:
    """The strings of an element. Script and style strings are not text."""
    return F.transform(ids_with_tag(nodes, inside(node), "#text"), lambda i: at(nodes, i)["text"])


def node_text(nodes: Column, node: Column) -> Column:
    """All text of an element, joined as it stands."""
    return F.array_join(strings_in(nodes, node), "")


def node_text_spaced(nodes: Column, node: Column) -> Column:
    """The stripped strings of an element joined by spaces, blank ones left out."""
    strings = F.transform(strings_in(nodes, node), strip)
    return F.array_join(F.filter(strings, lambda t: t != ""), " ")


def attr(node: Column, name: str) -> Column:
    """An attribute, empty when absent."""
    return F.coalesce(node["attrs"].getItem(name), F.lit(""))


def only_string(nodes: Column, node: Column) -> Column:
    """The text of an element that holds exactly one string and nothing else, else NULL.

    Elements nested one in one still count, as each has a single child.
    """
    leaf = at(nodes, node["last"])
    chain = F.forall(inside(node), lambda i: at(nodes, i)["last"] == node["last"])
    return F.when((node["last"] > node["id"]) & chain & leaf["tag"].startswith("#"), leaf["text"])
