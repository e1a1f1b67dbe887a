"""Job requests: JSON payloads as typed rows, absent fields filled in, bad ones told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.schema import REQUEST_DEFAULTS, REQUEST_TYPES, check_choice

# Words that stand for a flag.
_YES = ("1", "true", "t", "yes", "y", "on")
_NO = ("0", "false", "f", "no", "n", "off")


def job_requests(df: DataFrame, kind: str = "scrape", payload: str = "payload") -> DataFrame:
    """The rows of ``df`` with ``payload`` (JSON) replaced by the fields of a request.

    Unreadable JSON gives a row whose ``url`` is NULL; every other field has its default.
    A field of a wrong type has its default, too: ``rejected_requests`` names such rows,
    and ``accepted_requests`` leaves them out.
    """
    check_choice("request kind", kind, tuple(REQUEST_TYPES))
    rest = [c for c in df.columns if c != payload]
    parsed = df.select(*rest, F.try_parse_json(payload).alias("__given"))
    given = {name: _value(name, sort) for name, sort in _fields(kind)}
    fields = [given["url"].alias("url")]
    for name, default in REQUEST_DEFAULTS[kind].items():
        value = given[name] if default is None else F.coalesce(given[name], F.lit(default))
        fields.append(value.alias(name))
    return parsed.select(*rest, *fields)


def rejected_requests(df: DataFrame, kind: str = "scrape", payload: str = "payload") -> DataFrame:
    """The rows of ``df`` whose ``payload`` is no request, with ``reasons``, one per bad field.

    Refused are unreadable JSON, what is no object, a missing ``url``, and values of a wrong
    type. Numbers and flags may be written as strings.
    """
    return _with_reasons(df, kind, payload).filter(F.size("reasons") > 0)


def accepted_requests(df: DataFrame, kind: str = "scrape", payload: str = "payload") -> DataFrame:
    """The requests of ``job_requests`` whose payload nothing speaks against."""
    good = _with_reasons(df, kind, payload).filter(F.size("reasons") == 0).drop("reasons")
    return job_requests(good, kind, payload)


def _with_reasons(df: DataFrame, kind: str, payload: str) -> DataFrame:
    check_choice("request kind", kind, tuple(REQUEST_TYPES))
    parsed = df.withColumn("__given", F.try_parse_json(payload))
    problems = F.array_compact(F.array(*[_problem(kind, name, sort) for name, sort in _fields(kind)]))
    is_object = F.coalesce(F.schema_of_variant("__given").startswith("OBJECT"), F.lit(False))
    reasons = F.when(is_object, problems).otherwise(F.array(F.lit("payload: not a JSON object")))
    return parsed.withColumn("reasons", reasons).drop("__given")


def _fields(kind: str) -> list[tuple[str, str]]:
    return [tuple(field.split()) for field in REQUEST_TYPES[kind].split(", ")]


def _value(name: str, sort: str) -> Column:
    if sort != "boolean":
        return F.try_variant_get("__given", f"$.{name}", sort)
    word = F.lower(F.try_variant_get("__given", f"$.{name}", "string"))
    return F.when(word.isin(*_YES), True).when(word.isin(*_NO), False)


def _problem(kind: str, name: str, sort: str) -> Column:
    """What is wrong with a field, NULL if nothing is. An absent field has its default."""
    found = F.schema_of_variant(F.try_variant_get("__given", f"$.{name}", "variant"))
    if name == "url":
        missing = found.isNull() | (found == "VOID")
        return F.when(missing, "url: missing").when(found != "STRING", "url: not a string")
    if REQUEST_DEFAULTS[kind][name] is None:
        found = F.nullif(found, F.lit("VOID"))
    nested = found.startswith("OBJECT") | found.startswith("ARRAY")
    wrong = {
        "string": found != "STRING",
        "boolean": nested | _value(name, sort).isNull(),
        "double": nested | _value(name, sort).isNull(),
    }[sort]
    return F.when(found.isNotNull() & wrong, f"{name}: not a {sort}")
