"""Quality by the vote of the nearest labelled documents in a latent-semantic space.

A text is a vector of hashed byte trigram counts, dampened and weighted by how few
labelled texts have a trigram. The singular vectors of the labelled texts span the latent
space. A last term holds the share of words that only repeat the word before. Every
document is compared with every labelled vector, in blocks, by cosine; the nearest ones
vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.text import Powers, add_results, as_bytes, word_hashes

#: At most so many labelled documents of each class are used, those with the smallest hash
#: of their id, so that what is fitted on the driver and broadcast is bounded.
PER_CLASS = 2000
_BUCKETS = 2048
_BLOCK = 128
_PIECE = 1 << 20


class Model(NamedTuple):
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def term_counts(text: bytes, powers: Powers) -> np.ndarray:
    """Hashed counts of the byte trigrams of a whole text, and the share of repeating words."""
    counts = np.zeros(_BUCKETS + 1, np.float32)
    letters = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(letters) - 2), _PIECE):
        part = letters[start : start + _PIECE + 2].astype(np.uint32)
        codes = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        hashed = codes * np.uint32(2654435761) >> np.uint32(21)
        counts[:-1] += np.bincount(hashed, minlength=_BUCKETS)
    words = word_hashes(text, powers)[0]
    counts[-1] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0
    return counts


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _terms(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted terms; the share counts as much as all trigrams together."""
    return _unit(np.hstack([_unit(np.log1p(counts[:, :-1]) * idf), np.sqrt(counts[:, -1:])]))


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int) -> Model:
    """The latent space of labelled texts, and their places in it. Overwrites ``counts``, block by
    block, as it runs on the driver."""
    seen = np.zeros(_BUCKETS, np.int64)
    for start in range(0, len(counts), _BLOCK):
        seen += np.count_nonzero(counts[start : start + _BLOCK, :-1], axis=0)
    idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
    for start in range(0, len(counts), _BLOCK):
        counts[start : start + _BLOCK] = _terms(counts[start : start + _BLOCK], idf)
    values, vectors = np.linalg.eigh(counts.T @ counts)
    basis = np.ascontiguousarray(vectors[:, np.argsort(-values)[:dimensions]], np.float32)
    return Model(idf, basis, _unit(counts @ basis), labels.astype(np.float32))


def vote(counts: np.ndarray, model: Model, neighbours: int) -> np.ndarray:
    """The share of label 1 among the nearest labelled texts, weighted by similarity."""
    k = min(neighbours, len(model.labels))
    if not k:
        return np.full(len(counts), 0.5)
    places = _unit(_terms(counts, model.idf) @ model.basis)
    cosines = places @ model.vectors.T
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    # The power makes near neighbours count more; nobody on the other side counts.
    weights = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** 8
    total = weights.sum(axis=1)
    share = (weights * model.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-300)
    return np.where(total > 0, np.clip(share, 0, 1), model.labels.mean())


def held_out(doc_id: str = "doc_id"):
    """Whether a document is not to be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, label``: at most ``per_class`` documents of each label that may be learned from."""
    rows = labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    rows = rows.filter("doc_id is not null and label in (0, 1)").distinct()
    order = F.xxhash64("doc_id")
    one, two = (rows.filter(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1))
    return one.union(two)


def _counts(column: pa.Array) -> list[pa.Array]:
    powers = Powers()
    # Most counts of most texts are 0.
    packed = [zlib.compress(term_counts(text, powers).tobytes(), 1) for text in as_bytes(column)]
    return [pa.array(packed, pa.binary())]


def fit_quality(docs: DataFrame, labels: DataFrame, dimensions: int = 64, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents. The driver gets at most ``2 * per_class`` vectors, packed, and holds
    them in one matrix of 8 KB each: of texts that share an id the first in order is learned, however many there are."""
    sample = F.broadcast(labelled_sample(labels, per_class))
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = add_results(texts, ["doc_id", "label"], lambda: _counts, "counts binary").toArrow()
    keys = list(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), range(len(rows)), strict=True))
    keys.sort()
    counts = np.empty((len(keys), _BUCKETS + 1), np.float32)
    for place, (_, _, row) in enumerate(keys):
        counts[place] = np.frombuffer(zlib.decompress(rows["counts"][row].as_py()), np.float32)
    del rows
    return fit(counts, np.array([label for _, label, _ in keys]), dimensions)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    neighbours: int = 25,
    dimensions: int = 64,
    per_class: int = PER_CLASS,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns in ``carry`` and ``score``, from 0 to 1: how likely label 1 is.

    Every row is scored by its text alone. A missing or empty text, or one shorter than a
    trigram, gets the mean label of the sample, and so does everything if nothing near it
    is labelled; without any usable labels the score is 0.5. Labels other than 0 and 1 and
    those without ``doc_id`` are ignored; a document with both labels is learned as both.
    Equal texts get equal scores. Other columns of ``docs`` are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, dimensions, per_class))

    def make() -> Callable:
        powers = Powers()

        def per_batch(column: pa.Array) -> list[pa.Array]:
            texts, scores = list(as_bytes(column)), []
            for start in range(0, len(texts), _BLOCK):
                counts = np.stack([term_counts(text, powers) for text in texts[start : start + _BLOCK]])
                scores.append(vote(counts, model.value, neighbours))
            return [pa.array(np.concatenate(scores) if scores else [], pa.float64())]

        return per_batch

    return add_results(docs, carry, make, "score double")
