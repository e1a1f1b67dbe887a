"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are spans of wide patterns. For each, labelers of three sorts vote for, against
or not at all: strict regexes and checksums, gazetteers, and words of the context. The
votes of all documents are counted by pattern of votes; expectation-maximisation over
these counts estimates how reliable each labeler is for each kind of data, and the span
classifier (logistic regression) is trained on the resulting soft labels. Both see counts
of a few hundred patterns at most, whatever the number of documents.

Spans of the four base kinds are fixed by their patterns and always kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.text import add_results, as_strings

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
BASE = KINDS[:4]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Wide patterns of the spans that the method may add. All repeats are bounded.
_WIDE = {
    "email": re.compile(
        r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,4}(?![\w-])"
    ),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "name": re.compile(
        r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme|Mlle)\.? [^\W\d_a-z][^\W\d_A-Z]{1,30}"
        r"(?: [^\W\d_a-z][^\W\d_A-Z]{1,30})?(?!\w)"
    ),
}
# Some top-level domains, countries of bank accounts, given names.
_DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu nl ch at us ca au jp".split())
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE".split())
_GIVEN = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard "
    "Susan Joseph Thomas Sarah Charles Anna Peter Paul Maria Hans Klaus Sabine Jean Pierre Marie "
    "Jacques Camille Carlos Juan Carmen Pedro Ana Luis Sofia Emma Lukas Laura".split()
)
# Words that announce or rule out a kind.
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|correo|contact|write|adresse)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|telefon|tél|call|mobile|fax|cell|móvil|handy)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|sozialversicherung|seguridad social)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta)\b"),
    "name": re.compile(r"(?i)\b(?:name|dear|contact|signed|patient|nom|nombre|sincerely)\b"),
}
_AGAINST = re.compile(r"(?i)(?:isbn|issn|order|version|part|item|serial|no\.|nr\.|#|\$|€)\s*$")

_CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds, in time linear in the text."""
    found = []
    at, last, before = text.find("@"), 0, 0
    while at >= 0:
        local = text[max(last, before) : at]
        start = max(last, before) + len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            last = domain.end()
        before = at + 1
        at = text.find("@", before)
    if not _DIGIT.search(text):
        return found
    for chain in _DOTTED.finditer(text):
        parts, start = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x) <= 255 for x in (part.lstrip("0") or "0" for part in four)):
                found.append((start, 1, end))
            start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _valid(kind: str, span: str) -> int:
    """The vote of strict forms and checksums."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "phone":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "ssn":
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        return -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    if kind == "iban":
        plain = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "name":
        return 1 if span.count(" ") == 2 else 0
    return 1 if not re.search(r"\.\.|^\.", span) else -1


def _listed(kind: str, span: str) -> int:
    """The vote of the gazetteers."""
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip("])} "))[-1].lower() in _DOMAINS else -1
    if kind == "iban":
        return 1 if span[:2] in _COUNTRIES else -1
    if kind == "name":
        return 1 if span.split(" ")[1] in _GIVEN else 0
    if kind == "phone":
        return -1 if len(set(re.sub("[^0-9]", "", span))) < 3 else 0
    return -1 if span in ("123-45-6789", "078-05-1120") else 0


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, tuple]]:
    """``(start, kind number, end, votes and features)`` of wide spans that overlap no base one."""
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _WIDE.items():
        if kind in ("phone", "ssn", "iban") and not digits or kind == "email" and not _BRACKETED.search(text):
            continue
        for m in pattern.finditer(text):
            if any(start < m.end() and m.start() < end for start, _, end in base):
                continue
            span = m[0]
            left, right = text[max(0, m.start() - _CONTEXT) : m.start()], text[m.end() : m.end() + _CONTEXT]
            cue = 1 if _CUES[kind].search(left) else 0
            against = -1 if _AGAINST.search(left) else 0
            votes = (_valid(kind, span), _listed(kind, span), cue, against)
            features = (int(left[-1:] in ("", " ", "\n")), int(right[:1] in ("", " ", "\n", ".", ",")))
            yield m.start(), KINDS.index(kind), m.end(), (*votes, *features)


_BRACKETED = re.compile(r"[\[({] ?(?:at|AT|@) ?[\])}]")
_VOTES = 4


def estimate(patterns: list[tuple[int, tuple]], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """How likely a candidate of each pattern is true: EM over labelers that err independently.

    Every kind has its own share of true candidates and every labeler its own chance of
    each vote on true and on false ones. Labelers start as better than chance, and prior
    counts keep rare kinds near that start.
    """
    out = np.zeros(len(patterns))
    for kind in {k for k, _ in patterns}:
        mine = [i for i, (k, _) in enumerate(patterns) if k == kind]
        votes = np.array([patterns[i][1][:_VOTES] for i in mine]) + 1
        n = counts[mine].astype(float)
        prior = np.array([[1.0, 2.0, 7.0], [7.0, 2.0, 1.0]])  # true, false; against, none, for
        chance = np.repeat((prior / prior.sum(axis=1, keepdims=True))[:, None, :], _VOTES, axis=1)
        share = 0.5
        for _ in range(rounds):
            fit = np.log(chance[:, np.arange(_VOTES), votes]).sum(axis=2)
            odds = fit[0] - fit[1] + np.log(share / (1 - share))
            true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            share = (1 + (n * true).sum()) / (2 + n.sum())
            for side, weight in enumerate((n * true, n * (1 - true))):
                for v in range(3):
                    chance[side, :, v] = prior[side, v] + ((votes == v) * weight[:, None]).sum(axis=0)
            chance /= chance.sum(axis=2, keepdims=True)
        out[mine] = true
    return out


def _inputs(kind: int, pattern: tuple) -> np.ndarray:
    x = np.zeros(len(KINDS) + 2 * _VOTES + len(pattern) - _VOTES)
    x[kind] = 1
    for k, vote in enumerate(pattern[:_VOTES]):
        x[len(KINDS) + 2 * k] = vote > 0
        x[len(KINDS) + 2 * k + 1] = vote < 0
    x[len(KINDS) + 2 * _VOTES :] = pattern[_VOTES:]
    return x


def train(patterns: list[tuple[int, tuple]], counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Newton steps, with a penalty)."""
    size = len(_inputs(0, (0,) * (_VOTES + 2)))
    weights = np.zeros(size)
    if not patterns:
        return weights
    x = np.stack([_inputs(*pattern) for pattern in patterns])
    n = counts / counts.sum() * min(counts.sum(), 10_000)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (labels - p)) - 0.1 * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(size)
        weights = weights + np.linalg.solve(curve, slope)
    return weights


def fit_labelers(docs: DataFrame) -> np.ndarray:
    """The span classifier, from the votes on all documents. The driver gets counts by pattern."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in as_strings(batch.column(0)):
                for _, kind, _, pattern in candidates(text, base_spans(text)):
                    found[(kind, *pattern)] += 1
        keys = pa.array([list(key) for key in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(found.values(), pa.int64())], names=["pattern", "n"])

    counted = docs.select("text").mapInArrow(count, "pattern array<bigint>, n bigint")
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda row: row["pattern"])
    patterns = [(row["pattern"][0], tuple(row["pattern"][1:])) for row in rows]
    counts = np.array([row["n"] for row in rows], float)
    return train(patterns, counts, estimate(patterns, counts))


def find_spans(text: str, weights: np.ndarray, known: dict) -> tuple[list, list]:
    """Base spans, and all spans, as ``(start, kind number, end)`` in order."""
    base = base_spans(text)
    added = []
    for start, kind, end, pattern in candidates(text, base):
        if (kind, pattern) not in known:
            known[kind, pattern] = float(_inputs(kind, pattern) @ weights) > 0
        if known[kind, pattern] and not any(s < end and start < e for s, _, e in added):
            added.append((start, kind, end))
    return base, sorted([*base, *added])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as ``[KIND]``; of overlapping ones the first names all."""
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, ``base_spans``, ``spans`` and ``redacted``.

    Spans are texts ``kind:start:end`` by start, then by the order of ``KINDS``, joined by
    commas, in code points with the end exclusive; ``redacted`` is the text with all spans
    replaced by their kind. One row for each row of ``docs``; a missing or empty text has
    no spans and is redacted to an empty one. Equal texts get equal results, an empty
    table an empty one. Other columns are ignored.
    """
    weights = fit_labelers(docs)

    def make() -> Callable:
        known: dict = {}

        def per_batch(column: pa.Array) -> list[pa.Array]:
            rows = []
            for text in as_strings(column):
                base, spans = find_spans(text, weights, known)
                rows.append((_listing(base), _listing(spans), redact(text, spans)))
            return [pa.array([row[k] for row in rows], pa.string()) for k in range(3)]

        return per_batch

    return add_results(docs, carry, make, "base_spans string, spans string, redacted string")
