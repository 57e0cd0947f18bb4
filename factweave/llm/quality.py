"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with temperature.

Every word has a sparse random index vector, drawn from its hash. A word's vector is the sum of the index vectors of
its neighbours in the sample, scaled to unit length, and its own index vector; words share rows by hash. A document is
the mean of its words' vectors and of its words' shapes' vectors (a shape: the marks on a word, and whether it shouts),
with the lengths of both means and the share of different words. The network has one hidden layer of tanh; its logits
are divided by a temperature fitted on labelled documents that it did not learn from.

Defined results: a null text is an empty one (the zero vector) and scored like it; without labels of both kinds the score is
the labels' mean (0.5 without any); rows that repeat are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import tokens
from factweave.llm.labelled import labelled_texts

#: Labelled rows that the model is fitted on at most; rows of the vector table; dimensions; non-zeros; neighbours to a side.
SAMPLE, TABLE, DIMENSIONS, NONZERO, WINDOW = 12_000, 1 << 16, 32, 4, 2
HIDDEN, EPOCHS = 24, 60


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all table rows."""
    rng = np.random.default_rng(99)
    out = np.zeros((TABLE, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(TABLE), rng.integers(0, DIMENSIONS, TABLE)] += rng.choice([-1.0, 1.0], TABLE)
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 16)).astype(np.uint16)


def context_sums(lines: list[np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table that occur, the sum of their neighbours' index vectors) over sequences of rows."""
    gap = np.full(WINDOW, -1, np.int64)
    line = np.concatenate([x for d in lines for x in (d.astype(np.int64), gap)])
    seen = np.flatnonzero(np.bincount(line[line >= 0], minlength=TABLE)) if len(line) else np.zeros(0, np.int64)
    place = np.searchsorted(seen, line)
    context = np.zeros((len(seen), DIMENSIONS))
    for step in range(1, WINDOW + 1):
        ok = (line[:-step] >= 0) & (line[step:] >= 0)
        for x, y in ((place[:-step], line[step:]), (place[step:], line[:-step])):
            for j in range(DIMENSIONS):
                context[:, j] += np.bincount(x[ok], index[y[ok], j], len(seen))
    return seen, context


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Vectors of the table's rows from the texts of a sample: neighbours are summed where the texts lie, a bounded table
    of sums comes to the driver."""
    index = index_vectors()
    names = [f"x{j}" for j in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                words, shapes, bounds = tokens.words_and_shapes(*tokens.raw(part.column(0)))
                # Words and shapes have vectors of their own: shapes take part as words of a second sequence.
                rows, sums = context_sums([buckets(x)[bounds[i] : bounds[i + 1]] for i in range(part.num_rows) for x in (words, shapes)], index)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(sums[:, j], pa.float64()) for j in range(DIMENSIONS))], ["row", *names])

    found = sample.select("text").mapInArrow(run, ", ".join(["row int", *(f"{n} double" for n in names)]))
    found = found.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # TABLE rows at most
    context = np.zeros((TABLE, DIMENSIONS), np.float32)
    context[found.row.to_numpy(np.int64)] = found[names].to_numpy()
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.where(norm > 0, norm, 1) + index / NONZERO**0.5).astype(np.float32)


def pooled(body: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Document features [texts, 2 * DIMENSIONS + 3]."""
    words, shapes, bounds = tokens.words_and_shapes(body, off)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 2 * DIMENSIONS + 3), np.float32)
    if not len(full):
        return out
    starts, many = bounds[:-1][full], n[full][:, None]
    for k, part in enumerate((words, shapes)):
        rows = buckets(part)
        for j in range(DIMENSIONS):
            out[full, k * DIMENSIONS + j] = np.add.reduceat(np.ascontiguousarray(vectors[:, j])[rows], starts) / many[:, 0]
        out[full, 2 * DIMENSIONS + k] = np.linalg.norm(out[full, k * DIMENSIONS : (k + 1) * DIMENSIONS], axis=1)
    out[full, -1] = [len(tokens.distinct(words[bounds[d] : bounds[d + 1]])) / n[d] for d in full]
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The two layers by Adam on logistic loss, both labels weighing alike to the square root of their share."""
    rng = np.random.default_rng(5)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            h = np.tanh(x[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (1 - h**2)
            grads = [x[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d**2
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fit(docs: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE) -> Model:
    """The model from at most `rows` labelled documents whose id meets `learn`; every fourth only sets the temperature."""
    sample = labelled_texts(docs, labels, "quality", learn, rows)

    held = F.crc32(F.concat(F.col("id").cast("string"), F.lit(" temperature"))) % 4 == 0
    told = {(r.label, r.held): r["count"] for r in sample.groupBy("label", held.alias("held")).count().collect()}
    total = sum(told.values())
    prior = sum(n for (label, _), n in told.items() if label) / total if total else 0.5
    vectors = word_vectors(sample.where(~held))
    model = Model(vectors, np.zeros(1), np.ones(1), None, 1.0, prior)
    if not told.get((0, False)) or not told.get((1, False)):
        return model
    key = dict(sample.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(list(pooled(*tokens.raw(part.column(1)), vectors)), pa.list_(pa.float32()))], ["id", "label", "held", "x"])

    points = sample.select("id", "text", "label", held.alias("held")).mapInArrow(run, f"id {key}, label int, held boolean, x array<float>").toPandas()
    points["key"] = [zlib.crc32(f"{i} temperature".encode()) for i in points.id]
    points = points.sort_values(["key", "id"], kind="stable")
    x, y, hold = np.array(points.x.tolist(), float), points.label.to_numpy(float), points.held.to_numpy(bool)
    model.mean, model.scale = x[~hold].mean(0), x[~hold].std(0) + 1e-6
    model.weights = train((x[~hold] - model.mean) / model.scale, y[~hold])
    if hold.any():
        z = model.logit(x[hold])
        ts = np.exp(np.linspace(-1.5, 3, 46))
        loss = [np.mean(np.logaddexp(0, z / t) - y[hold] * z / t) for t in ts]
        model.temperature = float(ts[int(np.argmin(loss))])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of quality 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(pooled(*tokens.raw(part.column(1)), model.vectors)), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
