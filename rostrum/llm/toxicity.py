"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones train a linear classifier over the
distinct words of a text (each word by itself and its beginnings, hashed).  The risk estimator corrects the unlabelled part by the class
prior and is kept from going below zero; where it would, the step undoes the
overfit part instead.  Scoring is a map over the documents with a broadcast
weight per hash bucket.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import grams, samples

BUCKET_BITS = 18
HEADS = (3, 4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray, powers: grams.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature, in order; a bucket counts once a
    text, however many words lead to it.  Training and scoring both use this."""
    data = grams.LOWER[data]
    words = grams.Words(data, offsets, grams.ALNUM, powers)
    text, shift = words.text_of(), np.uint64(64 - BUCKET_BITS)
    key = grams.mix(words.hash + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    first = np.unique(key, return_index=True)[1]
    first.sort()
    text, start, stop, whole = text[first], words.start[first], words.stop[first], words.hash[first]
    total = np.zeros(len(data) + 1, np.uint64)
    up, down = powers.upto(len(data) + 1)
    np.cumsum(grams._byte_values()[data] * up[:-1], out=total[1:])

    def part(a, n, salt):
        return grams.mix((total[a + n] - total[a]) * down[a] + np.uint64(salt)) >> shift

    texts, buckets = [text], [grams.mix(whole) >> shift]
    for n in HEADS:
        ok = stop - start >= n
        texts.append(text[ok])
        buckets.append(part(start[ok], n, n))
    seen = np.unique(np.concatenate(texts) << BUCKET_BITS | np.concatenate(buckets).astype(np.int64))
    return seen >> BUCKET_BITS, seen & ((1 << BUCKET_BITS) - 1)


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.cumsum([0] + [len(r) for r in rows])


def _margin(w: np.ndarray, bias: float, rows: list[np.ndarray]) -> np.ndarray:
    flat, at = _sparse(rows)
    total = np.concatenate([[0.0], np.cumsum(w[flat])])
    return total[at[1:]] - total[at[:-1]] + bias


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def contrast(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: float = 5.0) -> np.ndarray:
    """Scale of each bucket: log ratio of its share among positive and among
    negative texts, the latter from the unlabelled share less the prior's part;
    0 where the two shares differ by fewer than ``least`` standard errors."""
    def share(rows):
        n = sum((np.bincount(np.unique(r), minlength=1 << BUCKET_BITS) for r in rows), np.zeros(1 << BUCKET_BITS))
        return n / len(rows)

    p, u = share(positive), share(unlabelled)
    both = (p * len(positive) + u * len(unlabelled)) / (len(positive) + len(unlabelled))
    error = np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
    negative = np.maximum(u - prior * p, 0) / (1 - prior)
    floor = 1 / len(unlabelled)
    return np.where(np.abs(p - u) >= least * error, np.log((p + floor) / (negative + floor)), 0.0)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, batch: int = 1024,
          rate: float = 0.3, decay: float = 1e-4, least: float = 5.0, slack: float = 0.25, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias.  Rows are arrays of buckets.  Each step
    takes a batch of both kinds, estimates  prior * P(+) + max(0, U(-) - prior *
    P(-))  (kept from falling below ``-slack * prior``) with the sigmoid loss, and steps by adaptive gradient; buckets whose
    shares do not differ have no weight.  Weights multiply the log ratios, start
    alike and stay non-negative: the loss is flat far from the boundary, where a
    feature once turned against its ratio could not come back.

    Without positives every text scores 0; without unlabelled rows the prior's
    log odds are the bias."""
    if not positive:
        return np.zeros(1 << BUCKET_BITS), -40.0
    prior = min(max(prior, 1e-4), 0.9)
    bias, b2 = float(np.log(prior / (1 - prior))), 1.0
    if not unlabelled:
        return np.zeros(1 << BUCKET_BITS), bias
    scale = contrast(positive, unlabelled, prior, least)
    w, g2 = np.where(scale != 0, 0.1, 0.0), np.full(len(scale), 1e-2)
    positive, unlabelled = ([r[scale[r] != 0] for r in rows] for rows in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    steps = -(-len(unlabelled) // batch)
    for _ in range(epochs):
        order, pos = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for s in range(steps):
            u = [unlabelled[i] for i in order[s * batch:(s + 1) * batch]]
            p = [positive[pos[(s * batch + i) % len(pos)]] for i in range(min(batch, len(pos)))]
            sp, su = _sigmoid(_margin(w * scale, bias, p)), _sigmoid(_margin(w * scale, bias, u))
            # Risk of a positive is 1 - s, of a negative s; both change by s * (1 - s).
            dp, du = prior * sp * (1 - sp) / len(p), su * (1 - su) / len(u)
            if su.mean() - prior * sp.mean() >= -slack * prior:
                gp, gu = -2 * dp, du
            else:  # the negative risk is overfit: step back along it
                gp, gu = dp, -du
            flat, at = _sparse(p + u)
            grad = np.bincount(flat, np.repeat(np.concatenate([gp, gu]), np.diff(at)), minlength=len(w)) * scale + decay * w
            used = np.flatnonzero(grad)
            g2[used] += grad[used] ** 2
            w[used] = np.maximum(w[used] - rate * grad[used] / np.sqrt(g2[used]), 0)
            gb = float(gp.sum() + gu.sum())
            b2 += gb ** 2
            bias -= rate / np.sqrt(b2) * gb
    return w * scale, bias


def _pack(data, offsets, powers) -> dict[str, list[bytes]]:
    text, bucket = features(data, offsets, powers)
    return {"buckets": [x.astype(np.uint32).tobytes() for x in np.split(bucket, np.searchsorted(text, np.arange(1, len(offsets) - 1)))]}


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_positive: int = 4_000,
        max_unlabelled: int = 6_000) -> tuple[np.ndarray, float]:
    """Train on at most ``max_positive`` rows confirmed by ``label`` = 1 and
    ``max_unlabelled`` rows taken without looking at a label; ``learn`` holds
    for all of them.  The class prior is the share of 1 among all labels of the
    learning part."""
    known = labels.where(F.col(label).isin(0, 1)).where(learn)
    prior = known.agg(F.avg(label)).first()[0] or 0.0
    kinds = [(known.where(F.col(label) == 1), max_positive), (docs.where(learn), max_unlabelled)]
    found = [[np.frombuffer(r["buckets"], np.uint32).astype(np.int64) for r in samples.take(docs, ids.select("doc_id", F.lit(1).alias("label")), n, _pack)]
             for ids, n in kinds]
    return train(*found, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], cutoff: float | None = None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, toxic is higher) of each row's whole
    text; null counts as empty and gets the bias alone.  With ``cutoff``, the
    rows of ``docs`` below it instead, all columns kept."""
    weight, bias = model[0].astype(np.float32), model[1]
    held = docs.sparkSession.sparkContext.broadcast(weight)

    def run(data, offsets, powers):
        text, bucket = features(data, offsets, powers)
        return {"score": _sigmoid(np.bincount(text, held.value[bucket], minlength=len(offsets) - 1) + bias)}

    if cutoff is None:
        return samples.map_texts(docs, run, {"score": pa.float64()})
    return samples.keep_texts(docs, lambda data, offsets, powers: run(data, offsets, powers)["score"] < cutoff)
