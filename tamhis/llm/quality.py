"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space."""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import Lists, Numbering, class_weights, col, map_texts, sample, text_slices

#: Features are hashed to so many columns; the model keeps so many latent dimensions and examples per class.
COLUMNS, DIMENSIONS, EXAMPLES = 4096, 32, 2000
NEIGHBOURS = 21
#: Votes weigh cosine to this power.
SHARPNESS = 8
#: A column for each share of words that repeat the word before them; all that a text reaches count its repeats.
REPEATED_SHARES = (0.02, 0.1, 0.3, 0.6)


FIRST = len(REPEATED_SHARES)


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, the rest as it is; runs are cut to two."""
    out = ""
    for c in word:
        k = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out.endswith(k * 2):
            out += k
    return out[:12]


def features(word: bytes) -> list[int]:
    """Columns of a word: the word in lower case, and its shape."""
    s = word.decode("utf-8", "replace")
    return [FIRST + zlib.crc32(f.encode("utf-8", "replace")) % (COLUMNS - FIRST) for f in ("w" + s.lower()[:64], "s" + shape(s))]


class Reader:
    """Sparse (column, 1 + log count) of a text."""

    def __init__(self):
        self.lists = Lists()
        self.words = Numbering(lambda w: self.lists.append(features(w)), self.lists.clear)

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        self.words.trim()
        numbers = self.words.numbers(text.split()) if text else np.empty(0, np.int64)
        counts = np.bincount(self.lists.gather(numbers)[0], minlength=COLUMNS) if len(numbers) else np.zeros(COLUMNS, np.int64)
        repeats = int((numbers[1:] == numbers[:-1]).sum())
        counts[:FIRST] = [repeats if repeats and repeats >= share * len(numbers) else 0 for share in REPEATED_SHARES]
        at = np.nonzero(counts)[0]
        return at, 1 + np.log(counts[at])


@dataclass
class QualityModel:
    """idf * projection, the examples' latent unit vectors, their labels and vote weights."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def latent(self, rows) -> np.ndarray:
        out = np.zeros((len(rows), self.projection.shape[1]), np.float32)
        for i, (at, weight) in enumerate(rows):
            if len(at):
                out[i] = weight.astype(np.float32) @ self.projection[at]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def votes(self, latent: np.ndarray) -> np.ndarray:
        """Share of votes for label 1 among the nearest examples; 0.5 for a text without direction."""
        if not len(self.labels):
            return np.full(len(latent), 0.5)
        cosines = latent @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS * self.weights[near]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), 0.5)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
        seed: int = 0) -> QualityModel:
    """Learn from the rows of ``docs`` and their labels (key, 0 or 1).

    Document frequencies cover all of ``docs`` (a vector of ``COLUMNS`` counts per task). The latent space is fitted to,
    and the neighbours are, the different texts among the ``EXAMPLES`` labelled documents per class with the smallest
    hash, a documented bound (see ``sample``). Without labels the model scores 0.5.
    """
    def frequencies(batches):
        read, total, n = Reader(), np.zeros(COLUMNS, np.int64), 0
        for batch in batches:
            for part in text_slices(batch, 0):
                for t in part.column(0).to_pylist():
                    total[read(t)[0]] += 1
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, COLUMNS)), pa.array(np.append(n, total))], ["at", "n"])

    texts = docs.select(col(text).cast("string").cast("binary").alias("t"))
    counted = dict(texts.mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
    total = counted.pop(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([counted.get(i, 0) for i in range(COLUMNS)], np.float64))) + 0.1

    def sparse(batches):
        read = Reader()
        for batch in batches:
            for part in text_slices(batch, 2):
                vectors = [read(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([v[0] for v in vectors], pa.list_(pa.int64())),
                     pa.array([v[1] for v in vectors], pa.list_(pa.float64()))], ["h", "label", "at", "weight"])

    different = sample(docs, labels, label, key, text, EXAMPLES, seed).select("h", "label", "t")
    vectors = different.mapInArrow(sparse, "h long, label long, at array<long>, weight array<double>")
    found = sorted(vectors.collect(), key=lambda r: (r["label"], r["h"]))
    matrix = np.zeros((len(found), COLUMNS), np.float32)
    for i, r in enumerate(found):
        matrix[i, r["at"]] = np.array(r["weight"]) * idf[r["at"]]
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    basis = principal(matrix / np.where(norm > 0, norm, 1), DIMENSIONS)
    labels_of = np.array([r["label"] for r in found], np.int64)
    share = class_weights(docs, labels, label, key, labels_of)
    model = QualityModel((idf[:, None] * basis).astype(np.float32), np.zeros((0, basis.shape[1]), np.float32), labels_of,
                         share[labels_of] if len(labels_of) else np.zeros(0))
    model.vectors = model.latent([(np.array(r["at"], np.int64), np.array(r["weight"])) for r in found])
    return model


def principal(matrix: np.ndarray, r: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    width = min(r, *matrix.shape)
    if not width:
        return np.zeros((matrix.shape[1], 1), np.float32)
    start = np.random.default_rng(0).standard_normal((matrix.shape[1], min(width + 16, *matrix.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(matrix @ start)
        start, _ = np.linalg.qr(matrix.T @ q)
    _, _, right = np.linalg.svd(matrix @ start, full_matrices=False)
    return (start @ right.T)[:, :width]


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep=("doc_id",), out: str = "score") -> DataFrame:
    """``keep`` columns and ``out`` (double, 0 to 1: votes for label 1) of every whole text.

    Cosines with all examples are exact, a block of texts at a time; the model is bounded by its constants. Null and blank
    texts score 0.5. Rows are independent; ties among neighbours at the last place are broken
    by the examples' order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        read = Reader()
        return lambda texts: [shared.value.votes(shared.value.latent([read(t) for t in texts]))]

    return map_texts(docs, text, keep, [(out, T.DoubleType())], start)
