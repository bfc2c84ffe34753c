"""Supervised subword embeddings: a quality classifier.

Every word, pair of words and run of 3 to 5 characters hashes to a bucket with
a learned vector; a text is the average of its vectors (each kind of
n-gram weighs alike), and a softmax layer gives the classes.  Vectors and layer are trained by stochastic gradient
descent in numpy.  As both layers are linear, scoring needs one number a bucket
and class: a map over the documents with that table broadcast.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import grams, samples

BUCKET_BITS = 16
CHARS = (3, 4, 5)
_CP = grams.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


class Grams(NamedTuple):
    """Buckets of one kind of n-gram: for each its place, and where texts begin
    among the places; ``live`` is false for runs that cross into the next text."""
    bucket: np.ndarray
    live: np.ndarray
    first: np.ndarray


def text_grams(data: np.ndarray, offsets: np.ndarray, powers: grams.Powers) -> list[Grams]:
    """All n-grams of a run of texts, case kept."""
    shift, out = np.uint64(64 - BUCKET_BITS), []
    words = grams.Words(data, offsets, grams.NOT_SPACE, powers)
    h, room = words.hash, words.room()
    out.append(Grams((grams.mix(h) >> shift).astype(np.int64), np.ones(len(h), bool), words.first))
    if len(h) > 1:
        # A word said twice is a gram of its own kind whatever the word.
        pair = np.where(h[1:] == h[:-1], np.uint64(1), grams.row_hash([h[:-1], h[1:]])) >> shift
        out.append(Grams(pair.astype(np.int64), room[:-1] > 1, np.minimum(words.first, len(pair))))
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    up, down = powers.upto(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((_CP[cp & 0xFFFF] + (cp >> 16).astype(np.uint64)) * up[:-1], out=total[1:])
    for n in CHARS:
        m = len(cp) - n + 1
        if m > 0:
            hashed = grams.mix((total[n:] - total[:-n]) * down[:m] + np.uint64(n)) >> shift
            live = np.ones(m, bool)
            ends = at[1:-1]
            for back in range(1, n):
                live[ends[(ends >= back) & (ends - back < m)] - back] = False
            out.append(Grams(hashed.astype(np.int64), live, np.minimum(at, m)))
    return out


def shares(data: np.ndarray, offsets: np.ndarray, powers: grams.Powers) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and each one's share of the average."""
    keys, weights, n_texts = [], [], len(offsets) - 1
    kinds = np.zeros(n_texts)
    for g in text_grams(data, offsets, powers):
        inside = slice(g.first[0], g.first[-1])
        text = np.repeat(np.arange(n_texts), np.diff(g.first))[g.live[inside]]
        n = np.bincount(text, minlength=n_texts)
        kinds += n > 0
        keys.append(text << BUCKET_BITS | g.bucket[inside][g.live[inside]])
        weights.append(1 / n[text])
    seen, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back.ravel(), np.concatenate(weights), minlength=len(seen)) / np.maximum(kinds, 1)[seen >> BUCKET_BITS]
    cut = np.searchsorted(seen >> BUCKET_BITS, np.arange(1, n_texts))
    return list(zip(np.split(seen & ((1 << BUCKET_BITS) - 1), cut), np.split(weight, cut)))


class Model(NamedTuple):
    """Per bucket the logit each class gains (rows of the product of vectors
    and layer), and the layer's bias."""
    gain: np.ndarray
    bias: np.ndarray


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int = 2, width: int = 8, epochs: int = 4,
          batch: int = 32, rate: float = 0.2, seed: int = 11) -> Model:
    """Vectors, layer and bias by adaptive stochastic gradient descent.  With no
    rows all classes are equally likely."""
    if not len(rows):
        return Model(np.zeros((1 << BUCKET_BITS, classes), np.float32), np.zeros(classes))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, width))
    layer, bias = rng.normal(0, 0.5, (width, classes)), np.zeros(classes)
    g_vec, g_layer, g_bias = np.full(1 << BUCKET_BITS, 1e-8), np.full(layer.shape, 1e-4), np.full(classes, 1e-2)
    labels = np.asarray(labels, np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(rows), batch):
            part = [rows[i] for i in order[s:s + batch]]
            flat = np.concatenate([b for b, _ in part])
            share = np.concatenate([w for _, w in part])
            who = np.repeat(np.arange(len(part)), [len(b) for b, _ in part])
            mean = np.stack([np.bincount(who, share * vectors[flat, k], minlength=len(part)) for k in range(width)], 1)
            logit = mean @ layer + bias
            soft = np.exp(logit - logit.max(1, keepdims=True))
            err = (soft / soft.sum(1, keepdims=True) - np.eye(classes)[labels[order[s:s + batch]]]) / len(part)
            back = err @ layer.T
            grad = np.stack([np.bincount(flat, share * back[who, k], minlength=len(vectors)) for k in range(width)], 1)
            used = np.flatnonzero(grad.any(1))
            g_vec[used] += (grad[used] ** 2).mean(1)
            vectors[used] -= rate * grad[used] / np.sqrt(g_vec[used])[:, None]
            for value, g, sq in ((layer, mean.T @ err, g_layer), (bias, err.sum(0), g_bias)):
                sq += g ** 2
                value -= rate * g / np.sqrt(sq)
    return Model((vectors @ layer).astype(np.float32), bias)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray, powers: grams.Powers) -> np.ndarray:
    """Class probabilities of each text; an empty one has the bias alone."""
    n_texts, classes = len(offsets) - 1, len(model.bias)
    total, kinds = np.zeros((n_texts, classes)), np.zeros(n_texts)
    for g in text_grams(data, offsets, powers):
        sums = np.concatenate([[0], np.cumsum(g.live)])
        n = sums[g.first[1:]] - sums[g.first[:-1]]
        kinds += n > 0
        for c in range(classes):
            got = np.concatenate([[0.0], np.cumsum(np.where(g.live, model.gain[g.bucket, c], 0).astype(np.float64))])
            total[:, c] += (got[g.first[1:]] - got[g.first[:-1]]) / np.maximum(n, 1)
    logit = total / np.maximum(kinds, 1)[:, None] + model.bias
    soft = np.exp(logit - logit.max(1, keepdims=True))
    return soft / soft.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = 3_000) -> Model:
    """Train on at most ``max_rows`` labelled rows for which ``learn`` holds.
    Rows without text or label are left out; classes are 0 and 1."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = samples.take(docs, known.where(learn), max_rows, _pack)
    pairs = [(np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["weights"], np.float32).astype(float)) for r in rows]
    return train(pairs, np.array([r["label"] for r in rows], np.int64))


def _pack(data, offsets, powers) -> dict[str, list[bytes]]:
    got = shares(data, offsets, powers)
    return {"buckets": [b.astype(np.uint16).tobytes() for b, _ in got], "weights": [w.astype(np.float32).tobytes() for _, w in got]}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score``, the probability of class 1, of each row's whole
    text.  Null counts as empty, which gets the score of the bias alone;
    repeated rows score alike.  Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(data, offsets, powers):
        return {"score": predict(Model(*held.value), data, offsets, powers)[:, 1]}

    return samples.map_texts(docs, run, {"score": pa.float64()})
