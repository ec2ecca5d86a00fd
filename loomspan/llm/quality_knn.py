"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a text are its words and its character shapes. Words (lower-cased, split at blanks) fall into ``WORDS`` hashed
buckets. For shapes every byte falls into one of 40 classes (all lower-case letters are one class, all capitals another, digits,
bytes beyond ASCII, blanks, line ends, each punctuation mark its own), and pairs and hashed triples of classes are counted over
the whole text, with a few terms for repeated lines, repeated words and words that repeat the one before. Counts are damped by log and
weighted by inverse document frequency; the word part and the shape part are each brought to a fixed length,
and both are projected by the leading singular vectors of a labelled sample to ``DIMENSIONS`` latent ones.

At most ``NEIGHBOURS`` labelled vectors (rows of smallest id hash, one text per id) are broadcast: a fixed
``NEIGHBOURS x DIMENSIONS`` floats. For each block of documents the cosine with all of them is computed
exactly, and the labels of the ``VOTERS`` nearest are weighted by similarity. A text is projected by itself, blocks have one
shape (the last is filled up) and cosines are rounded to nine places, so a score does not depend on the rows around it.

Defined cases: null or empty text has a zero vector, no neighbour is nearer than another and its score is
the share of label 1; very long texts are counted whole; rows repeated under one id are scored each for itself, equal texts
equally; of equally near neighbours the ones of smaller label number vote; no usable labels at all: every score is 0.5; repeated labels of one id count
as the larger one, repeated texts of one label as the smallest; null labels and null ids do not count; an empty table gives an empty
result; other columns of the input do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import hash_sample, map_arrow, one_text_each

NEIGHBOURS = 4_000
DIMENSIONS = 48
VOTERS = 25
SHARPNESS = 4.0
BLOCK = 256

CLASSES = 40
PAIRS = CLASSES * CLASSES
TRIPLES = 2048
EXTRA = 4
SHAPES = PAIRS + TRIPLES + EXTRA
WORDS = 8192
TERMS = SHAPES + WORDS
#: Length of the word part beside the shape part's 1.
WORD_PART = 0.5
MEMO = 300_000


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int32)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(256):
        if c >= 128:
            table[c] = 4
        elif chr(c).islower():
            table[c] = 0
        elif chr(c).isupper():
            table[c] = 1
        elif chr(c).isdigit():
            table[c] = 2
        elif c == 10:
            table[c] = 3
        elif c in marks:
            table[c] = 6 + marks.index(c)
        else:
            table[c] = 5
    return table


_CLASS = _class_table()
assert _CLASS.max() < CLASSES


def shape_counts(data: bytes) -> np.ndarray:
    """Counts of all shape terms."""
    out = np.zeros(SHAPES)
    c = _CLASS[np.frombuffer(data, np.uint8)]
    if len(c) > 1:
        pair = c[:-1] * CLASSES + c[1:]
        out[:PAIRS] = np.bincount(pair, minlength=PAIRS)
        if len(c) > 2:
            triple = ((pair[:-1] * CLASSES + c[2:]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(21)
            out[PAIRS : PAIRS + TRIPLES] = np.bincount(triple, minlength=TRIPLES)
    lines, words = data.split(b"\n"), data.split()
    n = PAIRS + TRIPLES
    out[n] = 64 * (1 - len(set(lines)) / len(lines))
    out[n + 1] = 64 * (1 - len(set(words)) / max(len(words), 1))
    out[n + 2] = min(len(words), 64)
    out[n + 3] = 4096 * sum(map(bytes.__eq__, words[:-1], words[1:])) / max(len(words), 1)
    return out


def term_counts(text: str | None, memo: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers of the terms of a text, and their counts."""
    data = (text or "").encode()
    if not data:
        return np.empty(0, np.int64), np.empty(0)
    memo = {} if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    shapes = shape_counts(data)
    at = np.flatnonzero(shapes)
    found = Counter(data.lower().split())
    buckets = np.zeros(WORDS)
    for word, n in found.items():
        bucket = memo.get(word)
        if bucket is None:
            bucket = memo[word] = zlib.crc32(word) % WORDS
        buckets[bucket] += n
    own = np.flatnonzero(buckets)
    return np.concatenate([at, own + SHAPES]), np.concatenate([shapes[at], buckets[own]])


def weighted(at: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Damped and weighted counts, each part of a fixed length."""
    x = np.log1p(counts) * weight[at]
    for part, length in ((at < SHAPES, 1.0), (at >= SHAPES, WORD_PART)):
        norm = np.sqrt((x[part] ** 2).sum())
        if norm > 0:
            x[part] *= length / norm
    return x


@dataclass
class VoteModel:
    """Labelled latent vectors and what projects a text among them."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    memo: dict[bytes, int] = field(default_factory=dict, repr=False)

    def project(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The unit vector of one text among the latent dimensions; of a text without terms zero."""
        x = weighted(at, counts, self.weight) @ self.basis[at]
        norm = np.sqrt((x**2).sum())
        return x / norm if norm > 0 else x

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of at most ``BLOCK`` texts."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        block = np.zeros((BLOCK, self.basis.shape[1]))
        for i, text in enumerate(texts):
            block[i] = self.project(*term_counts(text, self.memo))
        near = np.round(block @ self.vectors.T, 9)[: len(texts)]
        k = min(VOTERS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        votes = near > least
        ties = near == least
        votes |= ties & (np.cumsum(ties, axis=1) <= k - votes.sum(axis=1, keepdims=True))
        at = np.nonzero(votes)[1].reshape(len(texts), k)
        weight = np.maximum(np.take_along_axis(near, at, 1), 0) ** SHARPNESS
        voted = (weight * self.labels[at]).sum(axis=1)
        # one pseudo-vote of the prior keeps the score within (0, 1) and defines it for empty texts
        return (voted + self.prior) / (weight.sum(axis=1) + 1)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that never teaches; a null id is never held out nor taught from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_votes(docs: DataFrame, labels: DataFrame, rows: int = NEIGHBOURS, dimensions: int = DIMENSIONS) -> VoteModel:
    """Learn from ``labels`` (``doc_id, quality``) whose id is not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    taught = one_text_each(docs, hash_sample(known, "doc_id", rows), "doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [term_counts(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch(
            [batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.float64()))],
            ["doc_id", "quality", "at", "counts"],
        )

    got = map_arrow(taught.select("doc_id", "text", "quality"), run, "doc_id long, quality int, at array<int>, counts array<double>").toArrow().sort_by("doc_id").combine_chunks()
    y = (got["quality"].to_numpy() > 0).astype(np.float64)
    if not len(y):
        return VoteModel(np.ones(TERMS), np.zeros((TERMS, dimensions)), np.zeros((0, dimensions)), y, 0.5)
    lists = got["at"].combine_chunks()
    at, counts = lists.flatten().to_numpy().astype(np.int64), got["counts"].combine_chunks().flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    terms = [(at[a:b], counts[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    seen = np.bincount(at, minlength=TERMS)
    weight = np.log((1 + len(y)) / (1 + seen)) + 1
    basis = singular_vectors([(a, weighted(a, c, weight)) for a, c in terms], min(dimensions, len(y)))
    model = VoteModel(weight, basis, np.zeros((0, basis.shape[1])), y, float(y.mean()))
    model.vectors = np.stack([model.project(a, c) for a, c in terms])
    return model


def singular_vectors(rows: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors of sparse rows, by subspace iteration from a fixed start; few rows are dense at a time."""

    def blocks():
        for at in range(0, len(rows), BLOCK):
            own = rows[at : at + BLOCK]
            x = np.zeros((len(own), TERMS))
            for i, (terms, values) in enumerate(own):
                x[i, terms] = values
            yield at, x

    def down(q: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, q.shape[1]))
        for at, x in blocks():
            out += x.T @ q[at : at + len(x)]
        return out

    def up(v: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ v for _, x in blocks()])

    q, _ = np.linalg.qr(up(np.random.default_rng(7).standard_normal((TERMS, k + 8))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(up(np.linalg.qr(down(q))[0]))
    _, _, right = np.linalg.svd(down(q).T, full_matrices=False)
    return np.ascontiguousarray(right[:k].T)


def with_quality(docs: DataFrame, model: VoteModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        scores = np.concatenate([shared.value.score(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)])
        return pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, score double, predicted int")


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    return with_quality(docs, fit_votes(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
