"""Hashed n-gram features of a slice of texts, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import batches

#: Fixed odd multipliers of the hashes; any would do, but a model only fits the hashes it was trained with.
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: Stands for a word that equals the word before it.
_SAME = np.uint64(0x165667B19E3779F9)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same in every slice."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(lengths.max())
    powers = np.full(longest, _P, np.uint64)
    powers = np.cumprod(powers)
    where = batches.ragged(starts, lengths)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(where)) - np.repeat(begin, lengths)
    terms = (raw[where].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, begin))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _P) >> np.uint64(64 - bits)).astype(np.int64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact id in this slice, stable hash) of each word; each distinct word is hashed once."""
    ids, distinct = batches.word_ids(raw, starts, ends)
    own, offsets = batches.flat(distinct)
    return ids, hash_spans(own, offsets[:-1], offsets[1:])[ids] if len(ids) else np.zeros(0, np.uint64)


def bigrams(hashes: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each pair of neighbouring words; pairs of equal words all hash alike."""
    inside = doc[1:] == doc[:-1]
    pair = np.where(ids[1:] == ids[:-1], _SAME, mix(hashes[:-1] * _P + hashes[1:]))
    return pair[inside], doc[1:][inside]


def trigrams(raw: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the three bytes from each position on; the last two positions have none."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2].astype(np.uint32) | (raw[1:-1].astype(np.uint32) << 8) | (raw[2:].astype(np.uint32) << 16)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def trigram_spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each document's trigrams."""
    return offsets[:-1], np.maximum(np.diff(offsets) - 2, 0)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a slice's UTF-8 bytes."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]


def character_trigrams(points: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the three code points from each position on; the last two positions have none."""
    if len(points) < 3:
        return np.zeros(0, np.int64)
    code = points[:-2] * np.uint32(0x85EBCA6B) + points[1:-1] * np.uint32(0xC2B2AE35) + points[2:] * np.uint32(0x27D4EB2F)
    return (((code ^ (code >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def span_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of values[start : start + length] of every span."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts + lengths] - total[starts]


def labelled(labels: DataFrame, docs: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text", only=None) -> DataFrame:
    """(key, text, label) of at most ``bound`` labelled documents: those whose ids hash lowest, the same in every run.

    A document that is labelled more than once counts as positive if any label is; of several rows of one id the text of
    least hash counts, so as many rows as ids are drawn.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.filter(only) if only is not None else rows
    chosen = rows.groupBy(F.col(key).alias("l_key")).agg(F.max(label).alias("label")).orderBy(F.xxhash64("l_key"), "l_key").limit(bound)
    # bound rows of two numbers: small enough to broadcast whatever the corpus.
    met = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("key") == F.col("l_key"))
    return met.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Platt scaling with smoothed targets)."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on two parameters
        p = sigmoid(a * score + b)
        w, g = np.maximum(p * (1 - p), 1e-9), p - target
        h = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * score).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def arrow_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()

