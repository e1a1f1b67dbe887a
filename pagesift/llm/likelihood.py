"""Masked pseudo-likelihood of documents under a small bidirectional network.

The network reads two words on both sides of a masked one and predicts it: the embeddings
of the four, weighted by place, pass through tanh to a two-step softmax (group of words,
then word). Words are lower-cased; the most frequent ones of the whole corpus have numbers
of their own, all others share numbers by hash.

Every task trains on its documents, starting from the same parameters; a round masks one
position in as many as there are rounds, so that over all rounds every position of every
document is masked and learned once. The results of the tasks are averaged, weighted by how
much each task has seen. So the parameters gathered grow with the number of tasks, and no
task holds more than its own documents in batches. Scoring masks every position of every
document in turn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.text import add_results, as_bytes
from pagesift.plans.scratch import written

GROUPS = 32
SIZE = GROUPS * GROUPS
#: Numbers shared by words that are not frequent; 0 stands beyond either end of a text.
RARE = 256
DIMENSIONS = 32
PLACES = (-2, -1, 1, 2)
_BATCH = 4096
_STEPS = 64
_TOKENS = 1 << 17
_COUNTED = 300_000

_SHAPES = {
    "words": (SIZE, DIMENSIONS),
    "places": (len(PLACES), DIMENSIONS),
    "shift": (DIMENSIONS,),
    "groups": (DIMENSIONS, GROUPS),
    "group_shift": (GROUPS,),
    "members": (GROUPS, DIMENSIONS, GROUPS),
    "member_shift": (GROUPS, GROUPS),
}


def fresh() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    out = {name: rng.normal(0, 0.1, shape).astype(np.float32) for name, shape in _SHAPES.items()}
    out["places"] += 0.5
    return out


def flat(model: dict) -> np.ndarray:
    return np.concatenate([model[name].ravel() for name in _SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = values[at : at + n].astype(np.float32).reshape(shape)
        at += n
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of one column of every row, by parts that stay in a core's cache."""
    out = np.empty(len(x), x.dtype)
    for begin in range(0, len(x), _BATCH):
        rows = slice(begin, begin + _BATCH)
        part = x[rows] - x[rows].max(axis=-1, keepdims=True)
        chosen = part[np.arange(len(part)), at[rows]]
        out[rows] = chosen - np.log(np.exp(part, out=part).sum(axis=-1))
    return out


def _hidden(context: np.ndarray, model: dict) -> np.ndarray:
    """``context``: a row of four word numbers for every masked word."""
    out = np.empty((len(context), DIMENSIONS), model["shift"].dtype)
    # The table is weighted, which is smaller than what is gathered from it.
    weighted = [model["words"] * weight for weight in model["places"]]
    for begin in range(0, len(out), _BATCH):
        rows = slice(begin, begin + _BATCH)
        part = out[rows]
        part[:] = model["shift"]
        for k, table in enumerate(weighted):
            part += table.take(context[rows, k], axis=0)
        np.tanh(part, out=part)
    return out


def _by_group(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    group = (target // GROUPS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for k in range(GROUPS):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def log_probabilities(context: np.ndarray, target: np.ndarray, model: dict) -> np.ndarray:
    """The log-probability of every masked word."""
    hidden = _hidden(context, model)
    scores = hidden @ model["groups"] + model["group_shift"]
    out = _log_softmax_at(scores, target // GROUPS).astype(np.float64)
    for k, rows in _by_group(target):
        scores = hidden.take(rows, axis=0) @ model["members"][k]
        scores += model["member_shift"][k]
        out[rows] += _log_softmax_at(scores, target[rows] % GROUPS)
    return out


def train_step(context: np.ndarray, target: np.ndarray, model: dict, squares: dict, rate: float) -> None:
    """One Adagrad step on the mean log-probability of a batch, in place."""
    n = len(target)
    # The words of a group lie side by side.
    group = (target // GROUPS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    context, target, group = context.take(order, axis=0), target[order], group[order]
    bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    hidden, each = _hidden(context, model), np.arange(n)
    gradients = {name: np.zeros_like(model[name]) for name in ("members", "member_shift")}
    wrong = hidden @ model["groups"]
    wrong += model["group_shift"]
    wrong = _softmax(wrong)
    wrong[each, group] -= 1
    gradients["groups"], gradients["group_shift"] = hidden.T @ wrong, wrong.sum(axis=0)
    back = wrong @ model["groups"].T
    used = [(k, slice(bounds[k], bounds[k + 1])) for k in range(GROUPS) if bounds[k] < bounds[k + 1]]
    # One softmax for the members of all groups.
    wrong = np.empty((n, GROUPS), np.float32)
    for k, rows in used:
        np.matmul(hidden[rows], model["members"][k], out=wrong[rows])
        wrong[rows] += model["member_shift"][k]
    wrong = _softmax(wrong)
    wrong[each, target % GROUPS] -= 1
    for k, rows in used:
        gradients["members"][k] = hidden[rows].T @ wrong[rows]
        gradients["member_shift"][k] = wrong[rows].sum(axis=0)
        back[rows] += wrong[rows] @ model["members"][k].T
    back *= 1 - hidden * hidden
    gradients["shift"] = back.sum(axis=0)
    gradients["places"], gradients["words"] = np.zeros_like(model["places"]), np.zeros_like(model["words"])
    for k in range(len(PLACES)):
        order = np.argsort(context[:, k], kind="stable")
        used, starts = np.unique(context[order, k], return_index=True)
        sums = np.add.reduceat(back.take(order, axis=0), starts, axis=0)
        gradients["places"][k] = (sums * model["words"][used]).sum(axis=0)
        gradients["words"][used] += sums * model["places"][k]
    for name, gradient in gradients.items():
        gradient /= n
        squares[name] += gradient * gradient
        model[name] -= rate * gradient / np.sqrt(squares[name] + 1e-8)


def number_words(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint16, len(words))


class Numbers(dict):
    """Numbers of words; those of rare words come from their hash and are remembered for a while."""

    def __init__(self, frequent: dict[bytes, int]) -> None:
        super().__init__(frequent)
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) > _COUNTED:
            self.clear()
            self.update(self.frequent)
        number = self[word] = SIZE - RARE + xxhash.xxh3_64_intdigest(word) % RARE
        return number


def contexts(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The four neighbours of every word of some texts, and the words."""
    reach = max(PLACES)
    gap = np.zeros(reach, np.uint16)
    padded = np.concatenate([gap, *[part for text in numbers for part in (text, gap)]])
    inner = np.ones(len(padded), bool)
    inner[:reach] = False
    ends = np.cumsum([reach + len(text) for text in numbers])
    for k in range(reach):
        inner[ends + k] = False
    at = np.flatnonzero(inner)
    return np.stack([padded[at + place] for place in PLACES], axis=1), padded[at]


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: how often every word of all documents occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys, values = pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())
            return pa.RecordBatch.from_arrays([keys, values], names=["word", "n"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found.update(text.lower().split())
                if len(found) > _COUNTED:
                    yield out()
                    found.clear()
        yield out()

    counted = docs.select("text").mapInArrow(count, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def fit_vocabulary(docs: DataFrame) -> dict[bytes, int]:
    """Numbers of the most frequent words of all documents, from 1."""
    frequent = count_words(docs).orderBy(F.desc("n"), "word").limit(SIZE - RARE - 1)
    rows = sorted(frequent.collect(), key=lambda row: (-row["n"], row["word"]))
    return {bytes(row["word"]): k + 1 for k, row in enumerate(rows)}


def _train(
    batches: Iterator[pa.RecordBatch], start: np.ndarray, turn: int, rounds: int, rate: float
) -> Iterator[pa.RecordBatch]:
    model = unflat(start)
    squares = {name: np.full_like(values, 1e-4) for name, values in model.items()}
    seen, waiting, size = 0, [], 0

    def learn() -> int:
        context, target = contexts(waiting)
        # By the place in the document, which is the same in every round.
        masked = np.concatenate([np.arange(len(text)) for text in waiting]) % rounds == turn
        context, target = context[masked], target[masked]
        order = np.random.default_rng(len(target)).permutation(len(target))
        # Few words are learned in smaller batches.
        batch = max(8, min(_BATCH, len(order) // _STEPS))
        for begin in range(0, len(order), batch):
            rows = order[begin : begin + batch]
            if len(rows):
                train_step(context[rows], target[rows], model, squares, rate)
        return len(target)

    for batch in batches:
        for numbers in batch.column(0).to_pylist():
            waiting.append(np.frombuffer(numbers, np.uint16))
            size += len(waiting[-1])
            if size >= _TOKENS * 4:
                seen += learn()
                waiting, size = [], 0
    if size:
        seen += learn()
    if seen:
        values = flat(model)
        rows = [pa.array([values], pa.list_(pa.float32())), pa.array([seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, names=["values", "seen"])


def train(numbered: DataFrame, rounds: int = 2, rate: float = 0.1) -> dict[str, np.ndarray]:
    """Parameters averaged over all tasks, round by round."""
    values = flat(fresh())
    for turn in range(rounds):
        run = partial(_train, start=values, turn=turn, rounds=rounds, rate=rate)
        trained = numbered.select("numbers").mapInArrow(run, "values array<float>, seen bigint")
        each = trained.select("seen", F.posexplode("values").alias("k", "value"))
        mean = F.sum(F.col("value").cast("double") * F.col("seen")) / F.sum("seen")
        rows = each.groupBy("k").agg(mean.alias("value")).collect()
        if not rows:
            break
        values = np.array([row["value"] for row in sorted(rows, key=lambda row: row["k"])])
    return unflat(values)


def score_likelihood(docs: DataFrame, rounds: int = 2, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, ``n_tokens``, ``log_prob`` (the sum over all words of the
    log-probability given the words around) and ``mean_log_prob``.

    One row for each row of ``docs``. A missing or blank text has no words, a sum of 0 and a
    NULL mean. Rows are scored by their text alone, so equal texts get equal scores and
    missing ids stay missing. Other columns are ignored. An empty table gives an empty
    table.
    """
    frequent = fit_vocabulary(docs)

    def number() -> Callable:
        known = Numbers(frequent)
        return lambda column: [
            pa.array([number_words(text, known).tobytes() for text in as_bytes(column)], pa.binary())
        ]

    numbered = written(add_results(docs, carry, number, "numbers binary"), "numbers")
    model = docs.sparkSession.sparkContext.broadcast(train(numbered, rounds))

    def score() -> Callable:
        def per_batch(column: pa.Array) -> list[pa.Array]:
            texts = [np.frombuffer(numbers, np.uint16) for numbers in column.to_pylist()]
            sizes, sums = np.array([len(text) for text in texts], np.int64), np.zeros(len(texts))
            total, begin = np.cumsum(sizes), 0
            while begin < len(texts):
                done = total[begin] - sizes[begin]
                end = max(begin + 1, int(np.searchsorted(total, done + _TOKENS, "right")))
                context, target = contexts(texts[begin:end])
                each = np.zeros(len(target))
                for at in range(0, len(target), _TOKENS):
                    part = slice(at, at + _TOKENS)
                    each[part] = log_probabilities(context[part], target[part].astype(np.int64), model.value)
                owner = np.repeat(np.arange(begin, end), sizes[begin:end])
                sums += np.bincount(owner, each, minlength=len(texts))
                begin = end
            means = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
            return [pa.array(sizes), pa.array(sums), pa.array(means, pa.float64())]

        return per_batch

    results = "n_tokens bigint, log_prob double, mean_log_prob double"
    return add_results(numbered, carry, score, results, text="numbers")
