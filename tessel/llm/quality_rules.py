"""Quality rules: exact counts with fixed limits, then a calibrated logistic regression on hashed n-grams.

The model sees hashed word unigrams and bigrams and hashed character trigrams (three code points, blanks included), each
family as the frequencies of a text. It is fitted on at most ``FIT_ROWS`` labelled documents (those whose ids hash lowest), its scores
are turned into probabilities by Platt scaling on a quarter of them that the weights have not seen, and every text is
then scored whole, in Arrow batches, against the fixed threshold ``KEEP_AT``.

Memory: texts are taken in slices of a few MB; the model is two weight tables of 2 ** 13 numbers; the driver gets sparse
features of the bounded sample only.

Defined cases: null has no words, like an empty text, and fails the base rules; texts of any length count whole; without
labels of both kinds the model keeps everything that passes the base rules; repeated rows get equal results; an empty
table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import batches, features
from tessel.sources.tables import table

#: Labelled documents that the model is fitted on, at most.
FIT_ROWS = 3000
KEEP_AT = 0.5
BITS = 13
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _per_document(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[offsets[1:]] - np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[offsets[:-1]]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each document that lie in a window of WINDOW words found twice or more in it."""
    size = len(ids) - WINDOW + 1
    if size < 2:
        return np.zeros(n, np.int64)
    first = np.flatnonzero(doc[:size] == doc[WINDOW - 1 :])
    h = doc[first].astype(np.uint64)
    for k in range(WINDOW):
        h = features.mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[first + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    a, b = first[order][:-1][same], first[order][1:][same]
    equal = doc[a] == doc[b]
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    hit = np.zeros(len(ids), bool)
    hit[a[equal]] = hit[b[equal]] = True
    if not equal.all():  # two different windows share a hash: those documents are done by their exact windows
        hit[np.isin(doc, np.unique(np.concatenate([doc[a[~equal]], doc[b[~equal]]])))] = False
        for d in np.unique(np.concatenate([doc[a[~equal]], doc[b[~equal]]])):
            seen: dict[tuple, list[int]] = {}
            for i in first[doc[first] == d]:
                seen.setdefault(tuple(ids[i : i + WINDOW]), []).append(i)
            for places in seen.values():
                hit[places] |= len(places) > 1
    covered = np.zeros(len(ids) + WINDOW, np.int64)
    np.add.at(covered, np.flatnonzero(hit), 1)
    np.add.at(covered, np.flatnonzero(hit) + WINDOW, -1)
    return np.bincount(doc[np.cumsum(covered)[: len(ids)] > 0], minlength=n)


def duplicate_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each document that have a word and equal an earlier line of it."""
    n, breaks = len(offsets) - 1, np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    solid = np.concatenate([[0], np.cumsum(~batches.BLANK[raw])])
    # A break at the end of a document starts a last, empty line there; like other lines without a word it doesn't count.
    ends = np.maximum(starts, ends)
    worded = solid[ends] > solid[starts]
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ids, _ = batches.word_ids(raw, starts, ends)
    keys, counts = np.unique(doc * (int(ids.max(initial=0)) + 1) + ids, return_counts=True)
    return np.bincount(keys // (int(ids.max(initial=0)) + 1), weights=counts - 1, minlength=n).astype(np.int64) if len(keys) else np.zeros(n, np.int64)


@dataclass
class Model:
    """Weights of the hashed families, intercept, and the calibration."""

    words: np.ndarray
    characters: np.ndarray
    intercept: float
    slope: float
    offset: float


def _grams(raw, offsets, starts, ends, doc):
    """(bucket, document) of the word family; buckets of the character family by position, and each document's first one."""
    ids, hashes = features.word_hashes(raw, starts, ends)
    pair, owner = features.bigrams(hashes, ids, doc)
    points, places = features.code_points(raw, offsets)
    return ids, np.concatenate([features.bucket(hashes, BITS), features.bucket(pair, BITS)]), np.concatenate([doc, owner]), features.character_trigrams(points, BITS), places


def probabilities(model: Model, n: int, places, gram, owner, tri) -> np.ndarray:
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    by_word = np.bincount(owner, weights=model.words[gram], minlength=n) / total
    start, length = features.trigram_spans(places)
    by_character = features.span_sums(model.characters[tri], np.minimum(start, len(tri)), np.minimum(length, len(tri) - np.minimum(start, len(tri)))) / np.maximum(length, 1)
    return features.sigmoid(model.slope * (model.intercept + by_word + by_character) + model.offset)


def _sparse(raw, offsets) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's features: (index, frequency); character features come after the word features."""
    starts, ends, doc = batches.words(raw, offsets)
    _, gram, owner, tri, places = _grams(raw, offsets, starts, ends, doc)
    begin, length = features.trigram_spans(places)
    out = []
    for d in range(len(offsets) - 1):
        found = []
        for buckets, shift in ((gram[owner == d], 0), (tri[begin[d] : begin[d] + length[d]], 1 << BITS)):
            index, count = np.unique(buckets, return_counts=True)
            found.append((index + shift, count / max(1, len(buckets))))
        out.append(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
    return out


def collect_features(sample: DataFrame) -> list:
    """(id, label, indices, values) of a bounded sample, on the driver."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text", 1 << 18):
                sparse = _sparse(*batches.flat(part.column("text")))
                columns = [pa.array([i.astype("<i4").tobytes() for i, _ in sparse], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in sparse], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), *columns], names=["key", "label", "at", "share"])

    chosen = sample.select(F.col("key").cast("string").alias("key"), F.col("label").cast("int").alias("label"), "text")
    return chosen.transform(batches.bounded).mapInArrow(run, "key string, label int, at binary, share binary").collect()


def fit(rows: list, rounds: int = 120, ridge: float = 1e-4, rate: float = 0.5, scale: float = 30.0) -> Model | None:
    """Full-batch logistic regression with Adam; None without both labels."""
    rows = sorted(rows, key=lambda r: r.key)
    label = np.array([r.label for r in rows], np.float64)
    if not 0 < label.sum() < len(label):
        return None
    index = [np.frombuffer(r["at"], "<i4") for r in rows]
    value = [np.frombuffer(r["share"], "<f4") for r in rows]
    fold = np.arange(len(rows)) % 4 == 3
    if not 0 < label[fold].sum() < fold.sum():
        fold[:] = False
    lengths = np.array([len(i) for i in index])
    at, share = np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64) * scale
    row = np.repeat(np.arange(len(rows)), lengths)
    train = ~fold[row]
    # Both labels weigh alike in the fit; the calibration below restores the sample's proportions.
    weight = np.where(label > 0, 0.5 / label[~fold].mean(), 0.5 / (1 - label[~fold].mean())) / (~fold).sum()
    size = 2 << BITS
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    a_at, a_share, a_row = at[train], share[train], row[train]
    for step in range(1, rounds + 1):
        p = features.sigmoid(np.bincount(a_row, weights=a_share * w[a_at], minlength=len(rows)) + b)
        error = (p - label) * weight * ~fold
        g, gb = np.bincount(a_at, weights=a_share * error[a_row], minlength=size) + ridge * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        left, right = 1 - 0.9**step, 1 - 0.99**step
        w = w - rate * (m / left) / (np.sqrt(v / right) + 1e-6)
        b = b - rate * (mb / left) / (np.sqrt(vb / right) + 1e-6)
    score = np.bincount(row, weights=share * w[at], minlength=len(rows)) + b
    held = fold if fold.any() else ~fold
    spread = score[held].std() or 1.0
    slope, offset = features.platt(score[held] / spread, label[held])
    w = w * scale
    return Model(w[: 1 << BITS].copy(), w[1 << BITS :].copy(), float(b), slope / spread, offset)


def train(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = FIT_ROWS) -> Model | None:
    return fit(collect_features(features.labelled(labels, docs, label, bound, key, text)))


def judge_slice(texts: pa.Array, model: Model | None, keep_at: float = KEEP_AT) -> dict[str, np.ndarray]:
    """The counts, the base rules' verdict, the probability and the final verdict of each text."""
    raw, offsets = batches.flat(texts)
    n = len(offsets) - 1
    starts, ends, doc = batches.words(raw, offsets)
    ids, gram, owner, tri, places = _grams(raw, offsets, starts, ends, doc)
    n_words = np.bincount(doc, minlength=n)
    repeat = repeated_words(ids, doc, n)
    solid = ~batches.BLANK[raw]
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    p = np.ones(n) if model is None else probabilities(model, n, places, gram, owner, tri)
    return {
        "n_words": n_words, "word_chars": _per_document(solid & ((raw & 0xC0) != 0x80), offsets), "n_symbols": _per_document(_SYMBOL[raw], offsets),
        "n_dup_lines": duplicate_lines(raw, offsets), "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & (p >= keep_at), "probability": p,
    }


def judge(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"]

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                got = judge_slice(part.column("text"), shared.value, keep_at)
                yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(got[c]) for c in names]], names=["key", *names])

    schema = ", ".join([f"key {features.arrow_type(docs, key)}", *[f"{c} {k}" for c, k in zip(names, kinds, strict=True)]])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(batches.bounded).mapInArrow(run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(table(spark, sf_dir, "labels"), docs))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base rules alone, which need no model."""
    return judge(table(spark, sf_dir, "documents"), None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), v AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS five FROM d WHERE len(w) > 5
), m AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM v) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, i + unnest(range(5)) AS place FROM m) GROUP BY doc_id
), a AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a
"""
