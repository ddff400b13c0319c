"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one or two words
between, of the whole text.  Every coordinate has its own rate; the L1 term keeps
coordinates without steady evidence at exactly zero, so the weights that travel to the
scoring tasks are few (never more than 2**bits).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .tokens import BASE, blocks, mixed, text_bytes, word_numbers

GAPS = (1, 2, 3)  # a pair, and pairs with one and two words between


def feature_rows(data, offsets, bits: int):
    """(row, feature) of every word, pair and skip-gram of the texts, repeats included."""
    numbers, words = word_numbers(data, offsets, letters=True)
    row = np.repeat(np.arange(len(words) - 1), np.diff(words))
    shift = np.uint64(64 - bits)
    yield row, (numbers >> shift).astype(np.int64)
    for gap in GAPS:
        if len(numbers) > gap:
            inside = row[:-gap] == row[gap:]
            pair = mixed(numbers[:-gap] * np.uint64(BASE) + numbers[gap:] + np.uint64(gap))
            yield row[:-gap][inside], (pair[inside] >> shift).astype(np.int64)


def extractor(bits: int):
    """Per labelled row its distinct features, for training."""
    def extract(batches):
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for lo, hi in blocks(offsets):
                parts = list(feature_rows(data, offsets[lo:hi + 1], bits))
                row = np.concatenate([p[0] for p in parts])
                feature = np.concatenate([p[1] for p in parts])
                keys = np.unique(row << bits | feature)
                ends = np.searchsorted(keys >> bits, np.arange(hi - lo + 1))
                flat = (keys & ((1 << bits) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("label").slice(lo, hi - lo),
                     pa.array([flat[ends[i]:ends[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())],
                    ["label", "features"])
    return extract


def ftrl(samples: list[tuple[int, np.ndarray]], bits: int, epochs: int, alpha: float, beta: float, l1: float,
         l2: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) after FTRL-proximal passes over (label, features)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            label, idx = samples[i]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - label
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
            bias_n += g * g  # the bias has its own rate and no penalty
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept.astype(np.int64), w[kept].astype(np.float32), float(bias)


def scorer(kept: np.ndarray, weights: np.ndarray, bias: float, bits: int):
    def score(batches):
        table = np.zeros(1 << bits, np.float32)
        table[kept] = weights
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            out = np.empty(b.num_rows)
            for lo, hi in blocks(offsets):
                hits = []
                for row, feature in feature_rows(data, offsets[lo:hi + 1], bits):
                    hit = np.flatnonzero(table[feature])
                    hits.append(row[hit] << bits | feature[hit])
                keys = np.unique(np.concatenate(hits))
                total = np.bincount(keys >> bits, table[keys & ((1 << bits) - 1)], hi - lo) + bias
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in b.schema.names if c != "text"] + [pa.array(out)],
                [c for c in b.schema.names if c != "text"] + ["score"])
    return score


def train(labelled: DataFrame, bits: int = 20, sample_rows: int = 8000, epochs: int = 6, alpha: float = 2.0,
          beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from rows of (doc_id, text, label 0/1).

    About `sample_rows` rows, chosen by a hash of doc_id, are fitted (the documented bound
    of the sample); their features alone come to the driver, at most 4 * 2**bits bytes a
    row.  Rows with a null label are ignored.  Without any row the weights are empty and
    the bias gives a score of 0.
    """
    rows = text_batches(labelled).where(F.col("label").isNotNull())
    total = rows.count()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -700.0
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / total))
    sample = rows.where(pick).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    got = sample.select("label", "text").mapInArrow(extractor(bits), "label int, features binary").toArrow()
    samples = [(y, np.frombuffer(f, np.uint32).astype(np.int64))
               for y, f in sorted(zip(got["label"].to_pylist(), got["features"].to_pylist()))]
    if not samples:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -700.0
    return ftrl(samples, bits, epochs, alpha, beta, l1, l2, seed)


def toxicity(docs: DataFrame, labelled: DataFrame, bits: int = 20, **options) -> DataFrame:
    """Adds score (0 to 1, the chance of label 1) and predicted (score >= 0.5) to `docs` (text), for every row.

    Trained on `labelled` (doc_id, text, label).  The columns of `docs` other than text
    are passed on, but a column score or predicted of its own is replaced; only the text is looked at.  Null or empty text has no features: its score is
    the bias alone.  An empty table gives an empty result.
    """
    kept, weights, bias = train(labelled, bits, **options)
    keep = [f for f in docs.schema.fields if f.name not in ("text", "score", "predicted")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    out = docs.select(*[F.col(f"`{f.name}`") for f in keep], "text").mapInArrow(
        scorer(kept, weights, bias, bits), f"{fields}, score double" if fields else "score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
