"""Quality scores by positive-unlabelled learning.

A logistic model over text statistics minimises the non-negative unbiased risk: with class prior p, the loss of trusted
positives as positives counts p; the loss of unlabelled texts as negatives, less p times that of positives as negatives,
counts if it is above zero, and is otherwise pushed back up. The prior is estimated from positives and unlabelled texts
alone: a classifier of the two is fitted on one half of each, and of the other halves the least ratio of unlabelled to
positive shares above a threshold, allowing for sampling error, is the share of positives among unlabelled texts (best
bin estimation, Garg et al. 2021). Labels 0 play no part. Positives and unlabelled texts are bounded samples by a hash
of the id: at most POSITIVES and UNLABELLED rows, whatever the corpus holds, collected by one job. Every whole text is
then scored.

Features come from the text alone: shares of its bytes, lengths, repeated and distinct words, words in capitals. A null
text is empty; empty texts are scored from zeros like any other, very long ones whole. Rows don't meet in scoring, so
repeated rows share a score; new columns replace ones of the same name; an empty table gives an empty one. Rows with a
null id are scored, not learnt from. Without trusted positives or without unlabelled texts every score is 1.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import in_lots, prefix
from loomline.llm.shingles import word_hashes, word_spans

POSITIVES, UNLABELLED = 6000, 12000
STEPS, RATE, DECAY, SEED = 600, 0.05, 1e-3, 7
BLOCK = 1 << 20
N_STATS = 10


def features(texts: list[bytes]) -> np.ndarray:
    """A row of 256 + N_STATS numbers for each text."""
    out = np.zeros((len(texts), 256 + N_STATS), np.float32)
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or i + 1 == len(texts):
            out[start : i + 1] = block_features(texts[start : i + 1])
            start, size = i + 1, 0
    return out


def block_features(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    length = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)  # a space after each text: no word spans two
    ends = np.cumsum(length + 1)
    owner = np.repeat(np.arange(n, dtype=np.int64), length + 1)
    counts = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float64)
    counts[:, 32] -= 1
    first, end = word_spans(data)
    of = owner[first]
    words = np.bincount(of, minlength=n)
    h = word_hashes(data, first, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    distinct = np.bincount(of[order[new]], minlength=n)
    last = data[end - 1]
    upper = (data[first] >= 65) & (data[first] <= 90) & (end - first > 1) & (data[np.minimum(first + 1, len(data) - 1)] >= 65) & (data[np.minimum(first + 1, len(data) - 1)] <= 90)
    odd = ((last < 48) & (last != 46) & (last != 44)) | (last == 124)
    sums = lambda mask: np.bincount(of[mask], minlength=n)
    total, w = np.maximum(length, 1), np.maximum(words, 1)
    letters = counts[:, 65:91].sum(1) + counts[:, 97:123].sum(1) + counts[:, 128:].sum(1)
    stats = np.stack([
        np.log1p(length), np.log1p(words), sums(same) / w, np.log1p(words) - np.log1p(distinct), sums(upper) / w, sums(odd) / w,
        length / w / 8, letters / total, counts[:, 65:91].sum(1) / total, counts[:, 10] / total * 50,
    ], 1)
    return np.concatenate((np.sqrt(counts / total[:, None]), stats), 1).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, ...]:
    both = np.concatenate((positive, unlabelled)).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    return mean, scale, np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)


def descend(dim: int, gradient: Callable[[np.ndarray], np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Weights, the last one the bias, by Adam over whole samples; the same for the same samples."""
    w = np.append(np.random.default_rng(SEED).normal(0, 0.01, dim), 0.0)
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def loss(x: np.ndarray, w: np.ndarray, positive: bool) -> tuple[float, np.ndarray]:
    """The mean logistic loss of rows taken as positives or as negatives, and its gradient."""
    z = x @ w[:-1] + w[-1]
    d = sigmoid(z) - positive
    return float(np.logaddexp(0, -z if positive else z).mean()), np.append(x.T @ d, d.sum()) / len(x)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk, and the direction to descend along: its gradient, or away from a negative part below zero."""
    (as_positive, g_positive), (p_negative, gp), (u_negative, gu) = loss(positive, w, True), loss(positive, w, False), loss(unlabelled, w, False)
    rest, g_rest = u_negative - prior * p_negative, gu - prior * gp
    return prior * as_positive + max(0.0, rest), prior * g_positive + g_rest if rest >= 0 else -g_rest


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.05) -> float:
    """The share of positives among unlabelled rows, by best bin estimation over held-out halves."""
    if min(len(positive), len(unlabelled)) < 4:
        return 1.0
    mean, scale, p, u = scaled(positive, unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        return (loss(p[::2], w, True)[1] + loss(u[::2], w, False)[1]) / 2

    w = descend(p.shape[1], gradient, STEPS // 2)
    sp, su = (np.sort(x[1::2] @ w[:-1] + w[-1]) for x in (p, u))
    above_p = 1 - np.arange(len(sp)) / len(sp)
    above_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    error = math.sqrt(math.log(4 / sure) / 2 / len(su)) + math.sqrt(math.log(4 / sure) / 2 / len(sp))
    best = int(np.argmin((above_u + 1.01 * error) / above_p))
    return float(min(1.0, max(above_u[best] / above_p[best], 1 / len(su))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> dict[str, np.ndarray]:
    """Weights that minimise the non-negative risk."""
    mean, scale, p, u = scaled(positive, unlabelled)
    w = descend(p.shape[1], lambda w: risk(p, u, prior, w)[1])
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": np.array(w[-1])}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return sigmoid(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] + model["b"])


def text_features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_lots(batches, text):
            made = features([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array([x.tobytes() for x in made], pa.binary())], names=[*keep, "_x"])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("_x", T.BinaryType())])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """The model and prior, from labels (key, label) and the texts of df. An id with several rows brings all their texts."""
    rank = [F.xxhash64(F.col(key), F.lit(SEED)), F.col(key)]
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    trusted = known.where(F.col(label) == 1).select(key).distinct().orderBy(*rank).limit(positives)
    rest = df.select(key).where(F.col(key).isNotNull()).orderBy(*rank).limit(unlabelled).distinct()
    inner = prefix(*df.columns)
    kinds = [some.select(F.col(key).alias(f"{inner}id"), F.lit(kind).alias("_positive")) for some, kind in ((trusted, True), (rest, False))]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))  # at most positives + unlabelled ids
    rows = text_features(df.select(F.col(key), F.col(text).alias("_text")).join(chosen, F.col(key) == F.col(f"{inner}id")).select("_positive", "_text"), "_text", ["_positive"])
    got = rows.toArrow()  # one job; a row is a kilobyte whatever its text
    side = np.asarray(got.column("_positive"), bool)
    made = [np.frombuffer(x, np.float32) for x in got.column("_x").to_pylist()]
    p, u = [x for x, own in zip(made, side) if own], [x for x, own in zip(made, side) if not own]
    if not p or not u:
        return {"prior": 1.0}
    order = lambda some: np.array(sorted(some, key=lambda x: zlib.crc32(x.tobytes())))  # noqa: E731  sums don't depend on the order of rows
    p, u = order(p), order(u)
    prior = class_prior(p, u)
    return fit(p, u, min(prior, 0.999)) | {"prior": prior}


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each whole text, from 0 to 1."""
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_lots(batches, text):
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            made = predict(model, features(texts).astype(np.float64)) if "w" in model else np.full(len(texts), model["prior"])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(made, pa.float64())], names=kept + [out])

    return df.mapInArrow(run, schema)
