"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Texts become counts of character shapes, byte trigrams and repetition, weighted by inverse document
frequency and projected on the leading singular vectors of the labelled sample.  The labelled vectors
(a bounded sample) go to every task; each document meets all of them in exact blocked cosine products,
and its nearest neighbours vote with their similarity as weight, times the number of labelled rows that
one sampled row of their label stands for: the balance of the votes is that of all labelled rows.

Defined results: a null or empty text has no vector and gets the share of label 1 among all labelled
rows (0.5 if there is none), as does every text when nothing is labelled; repeated rows get equal
scores; only the text column is read.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgate.llm.words import LOWER, column_passes, scan

#: Buckets for hashed shape 4-grams and byte trigrams.
BUCKETS = 1024
#: Most labelled documents of each label.
PER_LABEL = 2048
DIMENSIONS = 64
NEIGHBOURS = 15

_SHAPE = np.arange(256, dtype=np.uint32) + 16
_SHAPE[0x30:0x3A] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x61:0x7B] = 3
_SHAPE[0x80:] = 3


class Model(NamedTuple):
    """Feature weights, projection, unit vectors of labelled documents, their labels, the share of label 1, and
    the labelled rows that a sampled row of each label stands for."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    stands_for: tuple = (1.0, 1.0)


def _histogram(codes, width, doc_of, n, offsets):
    """Hashed n-gram counts of each text; n-grams do not cross texts."""
    size = len(codes) - width + 1
    if size <= 0:
        return np.zeros((n, BUCKETS), np.float32)
    value = codes[:size].copy()
    for k in range(1, width):
        value = value * np.uint32(0x9E3779B1) + codes[k:size + k]
    bucket = (value * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    cell = doc_of[:size] * BUCKETS + bucket
    inner = offsets[1:-1]
    for k in range(1, width):
        crossing = inner - k
        crossing = crossing[(crossing >= 0) & (crossing < size)]
        cell[crossing] = n * BUCKETS
    return np.bincount(cell, minlength=n * BUCKETS + 1)[:n * BUCKETS].reshape(n, BUCKETS).astype(np.float32)


def _repeats(words, n):
    """Shares of words equal to the word before, to the one before that, and of repeated words of a text."""
    total = np.maximum(np.bincount(words.doc, minlength=n), 1)
    out = np.zeros((n, 3), np.float32)
    for k in (1, 2):
        same = (words.hash[k:] == words.hash[:-k]) & (words.doc[k:] == words.doc[:-k])
        out[:, k - 1] = np.bincount(words.doc[k:][same], minlength=n) / total
    order = np.lexsort((words.hash, words.doc))
    doc, value = words.doc[order], words.hash[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
    out[:, 2] = (np.bincount(doc[again], minlength=n) / total) ** 4
    return out


def features(column):
    """(rows lo..hi, matrix) of square-rooted shares, pass by pass."""
    for lo, hi, data, offsets in column_passes(column):
        n = hi - lo
        doc_of = np.repeat(np.arange(n), np.diff(offsets))
        shapes = _histogram(_SHAPE[data], 4, doc_of, n, offsets)
        trigrams = _histogram(LOWER[data].astype(np.uint32), 3, doc_of, n, offsets)
        size = np.maximum(np.diff(offsets), 1)[:, None]
        yield lo, hi, np.sqrt(np.concatenate([shapes / size, trigrams / size, _repeats(scan(data, offsets), n)], axis=1, dtype=np.float32))


def vectors(column, weights, projection):
    """Unit latent vectors of a text column; zero where a text has no features."""
    out = np.zeros((len(column), projection.shape[1]), np.float32)
    for lo, hi, rows in features(column):
        out[lo:hi] = (rows * weights) @ projection
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def fit(sample, counts, dimensions=DIMENSIONS, per_label=PER_LABEL):
    """Singular vectors and labelled vectors from a (text, label) sample of at most ``per_label`` ids of each label;
    ``counts`` are those of all labelled rows.  Features are made on the executors."""
    prior = counts[1] / sum(counts) if sum(counts) else 0.5
    stands_for = tuple(max(n / per_label, 1.0) for n in counts)

    def rows_of(batches):
        for batch in batches:
            label = batch.column("label")
            for lo, hi, rows in features(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [label.slice(lo, hi - lo), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], ["label", "row"])

    got = sample.select("text", "label").mapInArrow(rows_of, "label int, row binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["row"])))
    width = 2 * BUCKETS + 3
    if not got:
        return Model(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior, stands_for)
    matrix = np.stack([np.frombuffer(r["row"], np.float16) for r in got]).astype(np.float32)
    weights = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    weights[-3:] *= 2
    matrix *= weights
    values, basis = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    projection = basis[:, np.argsort(-values)[:dimensions]].astype(np.float32)
    latent = matrix @ projection
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-9)
    return Model(weights, projection, latent, np.array([r["label"] for r in got], float), prior, stands_for)


def vote(model, latent, neighbours=NEIGHBOURS, block=512):
    """Share of label 1 among the nearest labelled vectors, block by block; weights are similarity times rows stood for."""
    score = np.full(len(latent), model.prior)
    stands_for = np.where(model.labels == 1, model.stands_for[1], model.stands_for[0])
    k = min(neighbours, len(model.labels))
    for lo in range(0, len(latent) if k else 0, block):
        part = latent[lo:lo + block]
        cosine = part @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) * stands_for[near]
        total = weight.sum(axis=1)
        voted = (weight * model.labels[near]).sum(axis=1)
        has = (total > 0) & (np.abs(part).sum(axis=1) > 0)
        score[lo:lo + block][has] = voted[has] / total[has]
    return score


def quality(model, text_column):
    """Score in [0, 1] of every whole text; higher means label 1 is likelier."""
    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        return pa.array(np.clip(vote(model, vectors(text, model.weights, model.projection)), 0.0, 1.0))

    return of(text_column)
