"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE_WORDS`` words (the last may be shorter; a document without words is one
empty passage). Each passage becomes hashed frequencies of byte trigrams, words and word pairs, and an encoder layer turns
them into h = tanh(Wx + c). Gated attention gives every passage the weight softmax(g . (tanh(Vh) * sigmoid(Uh))) within
its document; the weighted sum of the h is the document, which a last layer scores. All weights are learned together
from document labels alone (Adam, cross-entropy); Platt scaling on a fifth of the rows that the weights have not seen
turns the last layer's output into the score.

Fitting uses at most ``FIT_ROWS`` labelled documents, those whose ids hash lowest among the rows allowed for learning
(crc32 of the id as text, modulo 3, is not 1), each with all of its passages. Of these documents, in that order, those
are taken that together have up to ``FIT_PASSAGES`` passages; one that alone has more than an eighth of that is not
drawn. Only that bounded sample reaches the driver. Scoring covers every passage of every document, in slices of a few MB; a document
larger than a slice is a slice of its own.

Defined cases: null scores like an empty text; without labels of both kinds every score is 1; repeated rows get equal
scores; an empty table gives an empty result; extra columns do no harm. The text is the only input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessel.llm import batches, features
from tessel.llm.source_mixing import word_count
from tessel.sources.tables import table

FIT_ROWS = 4000
#: Passages of all documents of the sample together; the driver holds two bytes a feature of each.
FIT_PASSAGES = 100_000
PASSAGE_WORDS = 64
BYTE_BITS, WORD_BITS = 8, 7
HIDDEN, GATE = 24, 12
#: Frequencies are small; this brings them to the range in which the encoder learns.
SCALE = 8.0
#: Text bytes that are scored at once; features take some fifty times as much.
SCORE_BYTES = 1 << 20
SIZE = (1 << BYTE_BITS) + (1 << WORD_BITS)


def held_out(key: str | Column) -> Column:
    """Rows that must not be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features [passage, SIZE], document of each passage); every document has at least one passage."""
    n = len(offsets) - 1
    starts, ends, doc = batches.words(raw, offsets)
    count = np.bincount(doc, minlength=n)
    bags = np.maximum(1, -(-count // PASSAGE_WORDS))
    first = np.cumsum(bags) - bags
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    passage = first[doc] + place // PASSAGE_WORDS
    total = int(bags.sum())
    x = np.zeros((total, SIZE), np.float32)
    if len(doc):
        head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        tail = np.concatenate([head[1:], [len(doc)]]) - 1
        begin, length = starts[head], np.maximum(ends[tail] - starts[head] - 2, 0)
        where = batches.ragged(begin, length)
        tri = features.trigrams(raw, BYTE_BITS)[where] + (np.repeat(passage[head], length) << BYTE_BITS)
        wide = np.bincount(tri, minlength=total << BYTE_BITS).reshape(total, -1)
        x[:, : 1 << BYTE_BITS] = wide / np.maximum(wide.sum(1, keepdims=True), 1)
        ids, hashes = features.word_hashes(raw, starts, ends)
        pair, owner = features.bigrams(hashes, ids, passage)
        gram = np.concatenate([features.bucket(hashes, WORD_BITS) + (passage << WORD_BITS), features.bucket(pair, WORD_BITS) + (owner << WORD_BITS)])
        wide = np.bincount(gram, minlength=total << WORD_BITS).reshape(total, -1)
        x[:, 1 << BYTE_BITS :] = wide / np.maximum(wide.sum(1, keepdims=True), 1)
    return x * np.float32(SCALE), np.repeat(np.arange(n), bags)


@dataclass
class Model:
    """Parameters by name, and the calibration."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0


def _start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"W": draw(SIZE, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "g": draw(GATE), "o": draw(HIDDEN), "b": np.zeros(1, np.float32)}


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Every intermediate value; ``bag`` is the document of each passage, ascending."""
    h = np.tanh(x @ p["W"] + p["c"])
    t, s = np.tanh(h @ p["V"]), features.sigmoid(h @ p["U"])
    e = (t * s) @ p["g"]
    first = np.searchsorted(bag, np.arange(n))
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = a / np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "first": first, "y": z @ p["o"] + p["b"][0]}


def _gradients(p: dict, x: np.ndarray, bag: np.ndarray, f: dict, dy: np.ndarray) -> dict[str, np.ndarray]:
    """Back-propagation of dy, the gradient at each document's output."""
    dz = dy[:, None] * p["o"]
    along = (f["h"] * dz[bag]).sum(1)
    de = f["a"] * (along - np.add.reduceat(f["a"] * along, f["first"])[bag])
    gated = f["t"] * f["s"]
    dt = de[:, None] * p["g"] * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * p["g"] * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ dpre, "c": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "g": gated.T @ de, "o": f["z"].T @ dy, "b": np.array([dy.sum()])}


def fit(bags: list[np.ndarray], label: np.ndarray, epochs: int = 24, size: int = 64, rate: float = 0.01, ridge: float = 1e-4) -> Model | None:
    """Learn from bags (one array [passage, SIZE] a document); None without both labels."""
    label = np.asarray(label, np.float64)
    if not 0 < label.sum() < len(label):
        return None
    fold = np.arange(len(bags)) % 5 == 4
    if not 0 < label[fold].sum() < fold.sum():
        fold[:] = False
    rows = np.flatnonzero(~fold)
    weight = np.where(label > 0, 0.5 / label[rows].mean(), 0.5 / max(1 - label[rows].mean(), 1e-9))
    p, rng, step = _start(), np.random.default_rng(7), 0
    m, v = ({k: np.zeros(w.shape) for k, w in p.items()} for _ in range(2))
    for _ in range(max(epochs, 400 * size // max(1, len(rows)) if len(rows) < 1000 else 0)):
        for chosen in np.array_split(rng.permutation(rows), max(1, len(rows) // size)):
            x = np.concatenate([bags[i] for i in chosen])
            bag = np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen])
            f = _forward(p, x, bag, len(chosen))
            dy = ((features.sigmoid(f["y"]) - label[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            step += 1
            for k, g in _gradients(p, x, bag, f, dy).items():
                g = g + ridge * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    held = np.flatnonzero(fold) if fold.any() else rows
    out = np.concatenate([_forward(p, bags[i], np.zeros(len(bags[i]), np.int64), 1)["y"] for i in held])
    spread = float(out.std()) or 1.0
    slope, offset = features.platt(out / spread, label[held])
    return Model(p, slope / spread, offset)


def drawn(sample: DataFrame, passages: int = FIT_PASSAGES) -> DataFrame:
    """Rows (key, text, label) of a bounded sample whose passages, added up in the order of the ids' hashes, stay within
    ``passages``."""
    sized = sample.withColumn("bags", F.greatest(F.lit(1), F.ceil(word_count("text") / PASSAGE_WORDS))).filter(F.col("bags") <= passages // 8)
    upto = Window.orderBy(F.xxhash64("d_key"), "d_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # FIT_ROWS rows of three numbers at most in this window.
    counted = sized.select(F.col("key").alias("d_key"), "bags").withColumn("total", F.sum("bags").over(upto)).filter(F.col("total") <= passages)
    return sample.join(F.broadcast(counted.select("d_key")), F.col("key") == F.col("d_key")).drop("d_key")


def collect_bags(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The bags and labels of the rows (key, text, label) of a bounded sample, on the driver, in the order of their ids."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                x, bag = passages(*batches.flat(part.column("text")))
                edge = np.searchsorted(bag, np.arange(part.num_rows + 1))
                out = [x[a:b].astype("<f2").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(out, pa.binary())], names=["key", "label", "bag"])

    chosen = sample.select(F.col("key").cast("string").alias("key"), F.col("label").cast("int").alias("label"), "text")
    rows = sorted(chosen.transform(batches.bounded).mapInArrow(run, "key string, label int, bag binary").collect(), key=lambda r: r.key)
    return [np.frombuffer(r.bag, "<f2").reshape(-1, SIZE).astype(np.float32) for r in rows], np.array([r.label for r in rows])


def train(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = FIT_ROWS) -> Model | None:
    sample = features.labelled(labels, docs, label, bound, key, text, only=~held_out(key))
    return fit(*collect_bags(drawn(sample)))


def score_slice(texts: pa.Array, model: Model | None) -> np.ndarray:
    raw, offsets = batches.flat(texts)
    if model is None:
        return np.ones(len(offsets) - 1)
    x, bag = passages(raw, offsets)
    out = _forward(model.weights, x, bag, len(offsets) - 1)["y"]
    return features.sigmoid(model.slope * out.astype(np.float64) + model.offset)


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs``, all columns kept, with the score in column ``name`` (which must be new)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found):
        for batch in found:
            for part in batches.slices(batch, text, SCORE_BYTES):
                got = score_slice(part.column(text), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*part.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.transform(batches.bounded).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(table(spark, sf_dir, "labels"), docs)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
