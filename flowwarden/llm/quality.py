"""Quality scores by attention-based multiple-instance learning: a document is a bag of passages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_functions
from .common import arrow_batches, text_or_empty

ship_functions(__name__)

#: Passages have at least so many bytes, and a document at most so many passages: those of longer texts are longer.
PASSAGE_BYTES, PASSAGES = 400, 64
#: Labelled documents that a model is fitted on, at most: the ones with the smallest hashes of their keys.
FIT_DOCUMENTS = 4000

_MARKS = b".,!?%*#$&|;:"
_CLASSES = 6 + len(_MARKS) + 1                       # lower, upper, digit, blank, line feed, beyond ASCII, each mark, others
_CLASS = np.full(256, _CLASSES - 1, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 13, 32]], _CLASS[10], _CLASS[128:] = range(6)
_CLASS[list(_MARKS)] = np.arange(6, 6 + len(_MARKS))
N_FEATURES = _CLASSES + 9


def encode(text: str) -> np.ndarray:
    """One row of features for each passage of a whole text; an empty text is one empty passage.

    Shares of character classes, size, word lengths, distinct and repeated words,
    capitalised words, and how much stands in lines that the document had before.
    """
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    step = max(PASSAGE_BYTES, -(-n // PASSAGES))
    blanks = np.flatnonzero((b == 32) | (b == 10))
    wanted = np.arange(step, n, step)
    at = np.searchsorted(blanks, wanted)
    cuts = np.unique(blanks[at[at < len(blanks)]]) if len(blanks) else blanks
    edges = np.concatenate([[0], cuts[cuts > 0], [n]])
    sizes = np.diff(edges)
    k = len(sizes)
    shares = np.bincount(np.repeat(np.arange(k), sizes) * _CLASSES + _CLASS[b], minlength=k * _CLASSES).reshape(k, _CLASSES) / sizes[:, None]
    seen, again, start = set(), np.zeros(k), 0
    for line in raw.split(b"\n"):
        if line in seen and line:
            again[np.searchsorted(edges, start, "right") - 1] += len(line)
        seen.add(line)
        start += len(line) + 1
    rows = np.empty((k, 8))
    for i in range(k):
        words = raw[edges[i]:edges[i + 1]].split()
        w = max(len(words), 1)
        length = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        counts = Counter(words)
        rows[i] = (
            np.log1p(sizes[i]), np.log1p(len(words)), length.mean(), length.std(), len(counts) / w, max(counts.values(), default=0) / w,
            sum(map(bytes.__eq__, words, words[1:])) / w, sum(map(bytes.istitle, words)) / w)
    return np.column_stack([shares, rows, again / sizes]).astype(np.float32)


@dataclass
class Model:
    """Passage encoder, gated attention and scorer; without parameters a constant ``base``."""

    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None


def _forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray):
    """Hidden passages, gates, attention within each bag, weighted bags and logits."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
    e = (t * s) @ p["w"]
    sizes = np.diff(np.append(starts, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return h, t, s, a, z, z @ p["c"] + p["d"][0], sizes


def _gradients(p, x, starts, y, weight):
    h, t, s, a, z, logit, sizes = _forward(p, x, starts)
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    g = {"c": z.T @ d, "d": np.array([d.sum()])}
    dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    g["w"] = (t * s).T @ de
    dt, ds = np.outer(de, p["w"]) * s * (1 - t * t), np.outer(de, p["w"]) * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit encoder, attention and scorer together by Adam; bags of one class only give their share."""
    y = np.asarray(labels, np.float64)
    base = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(float(base))
    rows = np.concatenate(bags).astype(np.float64)
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    sizes = np.array([len(b) for b in bags])
    first = np.cumsum(sizes) - sizes
    x = np.clip((rows - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    shapes = {"W": (x.shape[1], hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"b": np.zeros(hidden), "d": np.array([np.log(base / (1 - base))])}
    m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            at = np.concatenate([np.arange(first[j], first[j] + sizes[j]) for j in pick])
            starts = np.cumsum(sizes[pick]) - sizes[pick]
            g, step = _gradients(p, x[at], starts, y[pick], 1.0), step + 1
            lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k in p:
                grad = g[k] + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - lr * m[k] / (np.sqrt(v[k]) + 1e-8)
    return Model(float(base), mean, scale, p)


def score_bags(model: Model, bags: list[np.ndarray]) -> np.ndarray:
    if model.weights is None or not bags:
        return np.full(len(bags), model.base)
    x = np.clip((np.concatenate(bags) - model.mean) / model.scale, -8, 8)
    sizes = np.array([len(b) for b in bags])
    logit = _forward(model.weights, x, np.cumsum(sizes) - sizes)[5]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


_BAG = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("tie", T.LongType()), T.StructField("bag", T.BinaryType())])
_SCORE = T.StructType([T.StructField("_key", T.LongType()), T.StructField("score", T.DoubleType())])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([encode(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())], names=_BAG.names)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", documents: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most ``documents`` labelled rows: at most ``documents`` * ``PASSAGES`` passages reach the driver.

    Labels other than 0 and 1, null keys and null labels are passed over; a key with several labels
    takes their mean, one with several texts the text of smallest hash. Without labels, or with one class, the model is a constant.
    """
    arrow_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("_label"))
    few = known.where("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(documents)
    mine = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).join(F.broadcast(few), "_key")
    encoded = mine.select(F.col("_key").cast("bigint"), "_label", F.xxhash64("_text"), "_text").mapInArrow(_bags, _BAG)
    found = encoded.groupBy("key").agg(F.first("label").alias("label"), F.min_by("bag", "tie").alias("bag")).toPandas()
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found["bag"]]
    order = sorted(range(len(bags)), key=lambda i: (found["bag"][i], found["label"][i]))       # whatever order they came in
    return fit_bags([bags[i] for i in order], found["label"].to_numpy()[order] if order else np.zeros(0))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score``: how likely label 1 is, from the text alone; one row for each document.

    Texts are read whole. Null and empty texts are one empty passage, and equal texts get
    equal scores. Repeated rows and null keys are scored like others. No rows, no result.
    Other columns are ignored, whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_bags(model, [encode(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scores, 9))], names=_SCORE.names)

    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(key).cast("bigint").alias("_key"), text_or_empty(text).alias("_text"))
    return plain.mapInArrow(run, _SCORE).withColumnRenamed("_key", key)


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds``; null counts as empty."""
    return F.pmod(F.crc32(F.encode(text_or_empty(key), "UTF-8")), F.lit(folds))
