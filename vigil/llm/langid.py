"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is its byte n-grams inside words (with the spaces around them), hashed into
buckets.  Each bucket has an embedding; the average goes through a linear softmax.  Both
are trained by stochastic gradient descent in numpy.  A held-back part of the sample
calibrates the softmax temperature and the confidence below which a text is rejected.
For scoring, embeddings and output layer are multiplied into one table of a number per
bucket and language.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .tokens import blocks, text_bytes

GRAMS = (3, 4)
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray = None  # buckets x languages
    bias: np.ndarray = None
    temperature: float = 1.0
    reject_below: float = 0.0
    bits: int = 16


def letter_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) in small letters; ASCII that is no letter is a space."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = text_bytes(pc.utf8_lower(column))
    code = np.arange(256)
    fold = np.where((code >= 128) | ((code >= 97) & (code <= 122)), code, 32).astype(np.uint8)
    return fold[data], offsets


def grams(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(row, bucket) of every n-gram of the texts; inner bytes of an n-gram are never spaces."""
    first, last = int(offsets[0]), int(offsets[-1])
    part = data[first:last]
    ends = offsets[1:] - first
    row = np.repeat(np.arange(len(ends)), np.diff(offsets))
    x = part.astype(np.uint32)
    space = part == 32
    for n in GRAMS:
        m = len(part) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= x[j:j + m]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        good = row[:m] == row[n - 1:]
        for j in range(1, n - 1):
            good &= ~space[j:j + m]
        yield row[:m][good], (h >> np.uint32(32 - bits))[good]


def extractor(bits: int):
    def extract(batches):
        for b in batches:
            data, offsets = letter_text(b.column("text"))
            for lo, hi in blocks(offsets):
                parts = list(grams(data, offsets[lo:hi + 1], bits)) or [(np.zeros(0, int), np.zeros(0, np.uint32))]
                key = np.concatenate([p[0].astype(np.int64) << bits | p[1] for p in parts])
                keys, counts = np.unique(key, return_counts=True)
                ends = np.searchsorted(keys >> bits, np.arange(hi - lo + 1))
                bucket, counts = (keys & ((1 << bits) - 1)).astype(np.uint32), counts.astype(np.float32)
                cut = [slice(ends[i], ends[i + 1]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(lo, hi - lo), b.column("fold").slice(lo, hi - lo),
                     pa.array([bucket[c].tobytes() for c in cut], pa.binary()),
                     pa.array([counts[c].tobytes() for c in cut], pa.binary())],
                    ["lang", "fold", "buckets", "counts"])
    return extract


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples, languages: list[str], bits: int, dim: int, epochs: int, rate: float, seed: int):
    """Embeddings, output layer and bias from (language number, buckets, counts)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((len(languages), dim), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            y, idx, counts = samples[i]
            share = counts / counts.sum()
            lr = rate * (1 - done / steps)
            done += 1
            rows = emb[idx]
            h = share @ rows
            g = softmax(out @ h + bias)
            g[y] -= 1
            back = g @ out
            out -= lr * np.outer(g, h)
            bias -= lr * 0.1 * g
            emb[idx] = rows - (lr * len(idx)) * np.outer(share, back)
    return emb, out, bias


def calibrate(logits: np.ndarray, y: np.ndarray, lost: float, languages: int) -> tuple[float, float]:
    """Temperature with the least log loss; the confidence below which a text is rejected.

    That is half-way between chance and the confidence that all but a share `lost` of the
    rightly placed held-back texts reach.
    """
    best = min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(
        softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())
    p = softmax(logits / best)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    if not len(right):
        return float(best), 0.0
    return float(best), float((np.quantile(right, lost, method="lower") + 1 / languages) / 2)


def train(labelled: DataFrame, bits: int = 16, sample_rows: int = 2000, dim: int = 16, epochs: int = 6,
          rate: float = 0.5, held_back: int = 5, lost: float = 0.001, seed: int = 5) -> Model:
    """A model of (doc_id, text, lang) rows.

    About `sample_rows` rows, chosen by a hash of doc_id, are used (the documented bound of
    the sample), one in `held_back` for calibration alone.  Their n-gram counts come to
    the driver, not the texts.  Null languages and null texts are ignored; without any
    row the model knows no language and every text is `und`.
    """
    rows = text_batches(labelled).where("lang is not null and text is not null")
    total = rows.count()
    model = Model(bits=bits)
    if not total:
        return model
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    sample = rows.where(part < int((1 << 30) * min(1.0, sample_rows / total)))
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(held_back)).cast("int")
    got = sample.select("lang", "text", fold.alias("fold")).mapInArrow(
        extractor(bits), "lang string, fold int, buckets binary, counts binary").toArrow()
    got = got.filter(pc.greater(pc.binary_length(got["buckets"]), 0)).sort_by(
        [("lang", "ascending"), ("buckets", "ascending"), ("counts", "ascending")])
    if not got.num_rows:
        return model
    model.languages = sorted(set(got["lang"].to_pylist()))
    number = {v: i for i, v in enumerate(model.languages)}
    folds = {True: [], False: []}
    for lang, fold_, buckets, counts in zip(got["lang"], got["fold"], got["buckets"], got["counts"]):
        folds[fold_.as_py() == 0].append((number[lang.as_py()], np.frombuffer(buckets.as_buffer(), np.uint32),
                                          np.frombuffer(counts.as_buffer(), np.float32)))
    learn, check = folds[False] or folds[True], folds[True] or folds[False]
    emb, out, model.bias = fit(learn, model.languages, bits, dim, epochs, rate, seed)
    model.table = (emb @ out.T).astype(np.float32)
    logits = np.stack([(counts / counts.sum()) @ model.table[idx] + model.bias for _, idx, counts in check])
    model.temperature, model.reject_below = calibrate(logits, np.array([s[0] for s in check]), lost,
                                                      len(model.languages))
    return model


def predictor(model: Model, text: str):
    def predict(batches):
        columns = [np.ascontiguousarray(model.table[:, c]) for c in range(len(model.languages))]
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            data, offsets = letter_text(b.column(text))
            n = b.num_rows
            letters = pc.fill_null(pc.match_substring_regex(b.column(text), r"\p{L}"), False).to_numpy(False)
            best, score = np.zeros(n, int), np.zeros(n)
            for lo, hi in blocks(offsets):
                total, seen = np.zeros((hi - lo, len(columns))), np.zeros(hi - lo)
                for row, bucket in grams(data, offsets[lo:hi + 1], model.bits):
                    ends = np.searchsorted(row, np.arange(hi - lo + 1))
                    seen += np.diff(ends)
                    for c, column in enumerate(columns):
                        sums = np.concatenate([[0.0], np.cumsum(column[bucket], dtype=np.float64)])
                        total[:, c] += sums[ends[1:]] - sums[ends[:-1]]
                p = softmax((total / np.maximum(seen, 1)[:, None] + model.bias) / model.temperature)
                best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            names = np.array(model.languages, object)[best]
            names[~letters] = UNKNOWN
            score[~letters] = 0.0
            kept = [c for c in b.schema.names if c != "looked_at"]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(names.tolist(), pa.string()), pa.array(score),
                                               pa.array(~letters | (score < model.reject_below))],
                [*kept, "lang_pred", "score", "rejected"])
    return predict


def identify(docs: DataFrame, model: Model, keep: list[str],
             names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred, score (calibrated confidence) and rejected, row by row.

    `names` names these three, where a kept column has one of the names already.

    Only the text is looked at.  A text that is null or has no letter is `und` with score
    0 and rejected; so is every text if the model knows no language.  A text whose
    confidence is below the model's is rejected but keeps its best language.  Texts with
    letters but without n-grams get the languages' bias.  An empty table gives an empty result.
    """
    types = dict(docs.dtypes)
    if not model.languages:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(UNKNOWN).alias(names[0]),
                           F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2]))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    text = f"c{keep.index('text')}" if "text" in keep else "looked_at"  # a kept text travels once
    slim = text_batches(docs).select(*own, *([] if "text" in keep else [F.col("text").alias("looked_at")]))
    inner = "".join(f"c{i} {types[c]}, " for i, c in enumerate(keep))
    out = slim.mapInArrow(predictor(model, text), inner + "lang_pred string, score double, rejected boolean")
    return out.toDF(*keep, *names)
