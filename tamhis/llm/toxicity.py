"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import Lists, Numbering, class_weights, col, first_rows, largest, map_texts, sample, text_slices
from tamhis.workspace import written

#: Terms are words and their beginnings of these lengths (which catch inflected forms).
PREFIXES = (4, 5)
#: The labelled rows that terms are chosen from: so many per class.
FIT_ROWS = 10_000
#: Size of the model: terms that tell the classes apart best, and examples per class.
TELLING_TERMS, EXAMPLES = 2000, 1000
#: A telling term must occur in so many different labelled texts, and have so large a chi-square.
MIN_TEXTS, MIN_CHI = 4, 20
#: The term of all words without a telling one, and its idf: how much their number weighs.
OTHER, OTHER_IDF = b"", 1.0
BLOCK = 64
NEIGHBOURS = 15
#: Votes weigh cosine to this power, over squared distance.
SHARPNESS = 4
TASK_TERMS = 500_000
_STRIP = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def terms(word: bytes) -> set[bytes]:
    """Terms of a word: its letters in lower case, and its beginnings (marked with a ``*``)."""
    w = word.strip(_STRIP).decode("utf-8", "replace").lower()
    if not w:
        return set()
    return {w.encode(), *[(w[:n] + "*").encode() for n in PREFIXES if len(w) > n]}


@dataclass
class ToxicityModel:
    """Vocabulary with idf, and the examples as postings sorted by (block, term)."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    labels: np.ndarray
    keys: list
    start: np.ndarray      # (blocks, terms + 1) -> first posting
    example: np.ndarray    # per posting
    weight: np.ndarray
    most: np.ndarray       # (terms, blocks): largest weight
    prior: np.ndarray      # vote weight per class: undoes the balanced choice of examples

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a positive cosine; ties go to the smaller number.

        Blocks are read in descending order of the largest cosine they can hold, until none left can reach the k-th.
        """
        bound = weight @ self.most[at]
        order = np.argsort(-bound, kind="stable")
        best, found = np.empty(0, np.float32), np.empty(0, np.int64)
        done, step = 0, 4
        while done < len(order):
            floor = best[k - 1] if len(best) >= k else 0.0
            blocks = order[done:done + step]
            blocks = blocks[bound[blocks] >= max(floor * (1 - 1e-5), 1e-9)]
            if not len(blocks):
                break
            first = self.start[blocks][:, at]
            size = (self.start[blocks][:, at + 1] - first).ravel()
            ends = np.cumsum(size)
            spots = np.repeat(first.ravel() - (ends - size), size) + np.arange(int(ends[-1]))
            sims = np.bincount(self.example[spots], self.weight[spots] * np.repeat(np.tile(weight, len(blocks)), size),
                               len(self.labels))
            numbers = np.nonzero(sims)[0]
            best, found = np.concatenate([best, sims[numbers]]), np.concatenate([found, numbers])
            if len(best) > k:
                top = np.lexsort((found, -best))[:k] if len(best) < 200 else self._top(best, found, k)
                best, found = best[top], found[top]
            done += step
            step *= 4
        order = np.lexsort((found, -best))
        return found[order], best[order]

    @staticmethod
    def _top(best, found, k):
        cut = np.partition(best, len(best) - k)[len(best) - k]
        rows = np.nonzero(best >= cut)[0]
        return rows[np.lexsort((found[rows], -best[rows]))[:k]]


def _vector(numbers: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector of a text's term numbers: terms and weights."""
    counts = np.bincount(numbers, minlength=len(idf))
    at = np.nonzero(counts)[0]
    weight = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((weight * weight).sum())
    return at, (weight / norm if norm else weight).astype(np.float32)


class _Reader:
    """Numbers of the terms in a text; a word without a known term counts as ``OTHER``, term 0."""

    def __init__(self, vocabulary):
        self.lists = Lists()
        self.words = Numbering(
            lambda w: self.lists.append([vocabulary[t] for t in terms(w) if t in vocabulary] or [vocabulary[OTHER]]),
            self.lists.clear)

    def __call__(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        self.words.trim()
        return self.lists.gather(self.words.numbers(text.split()))[0]


def _count_terms(batches):
    """(term, n, toxic): in how many texts (and toxic texts) of a task a term occurs, a bounded table at a time."""
    def learn(word):
        lists.append([known.setdefault(t, len(known)) for t in terms(word)])

    def flush():
        n = len(known)
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(known), pa.binary()), *[pa.array(c[:n].copy()) for c in counts]], ["term", "n", "toxic"])
        for x in (known, lists, words):
            x.clear()
        for c in counts:
            c[:] = 0
        return out

    known, lists, counts = {}, Lists(), [np.zeros(TASK_TERMS, np.int64) for _ in range(2)]
    words = Numbering(learn, lists.clear)
    for batch in batches:
        for part in text_slices(batch, 0):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                at = np.unique(lists.gather(words.numbers(list(set(text.split()))))[0])
                if len(known) > len(counts[0]):
                    counts = [np.concatenate([c, np.zeros(len(known), np.int64)]) for c in counts]
                counts[0][at] += 1
                counts[1][at] += label
            if len(known) >= TASK_TERMS:
                yield flush()
    if known:
        yield flush()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
        seed: int = 0) -> ToxicityModel:
    """Learn from the rows of ``docs`` and their labels (key, 0 or 1).

    Terms are chosen on a bounded sample (see ``sample``) by the largest chi-square. Copies and most near copies count
    once there, so a large group of them teaches no more than one. The terms' document frequencies cover all of ``docs``. The examples are the ``EXAMPLES`` sampled texts per
    class with the smallest hash. Without a toxic example everything scores 0.
    """
    spark = docs.sparkSession
    different = sample(docs, labels, label, key, text, FIT_ROWS, seed)
    total, toxic = (int(x or 0) for x in different.select(F.count("*"), F.sum("label")).first())
    counted = different.select("t", "label").mapInArrow(_count_terms, "term binary, n long, toxic long")
    table = written(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "terms")
    a, n = F.col("toxic").cast("double"), F.col("n").cast("double")
    expected = n * toxic / max(total, 1)
    chi = (a - expected) * (a - expected) / (expected * (1 - n / (total + 1)) + 1e-9)
    telling = table.filter(f"n >= {MIN_TEXTS}").withColumn("chi", chi).filter(f"chi >= {MIN_CHI}")
    telling = first_rows(telling, TELLING_TERMS, largest(F.col("chi")), F.desc("chi"), F.col("term")).select("term").collect()
    vocabulary = {t: i for i, t in enumerate(sorted({OTHER, *(bytes(r[0]) for r in telling)}))}
    idf = _idf(docs.select(col(text).cast("string").cast("binary").alias("t")), vocabulary)
    order = F.xxhash64("h", F.lit(seed))
    chosen = [different.filter(F.col("label") == c).orderBy(order, "h").limit(EXAMPLES).select("t", "label", "key") for c in (0, 1)]
    shared = spark.sparkContext.broadcast((vocabulary, idf))

    def vectors(batches):
        words, weights = shared.value
        read = _Reader(words)
        for batch in batches:
            for part in text_slices(batch, 0):
                rows = [_vector(read(t), weights) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["label", "key", "at", "weight"])

    kind = different.schema["key"].dataType.simpleString()
    found = chosen[0].union(chosen[1]).mapInArrow(
        vectors, f"label long, key {kind}, at array<long>, weight array<float>").collect()
    prior = class_weights(docs, labels, label, key, np.array([r["label"] for r in found], np.int64))
    return index(vocabulary, idf, found, prior)


def _idf(texts: DataFrame, vocabulary) -> np.ndarray:
    """Inverse document frequencies over all texts; each task sends one row per term."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        read, counts, n = _Reader(shared.value), np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for part in text_slices(batch, 0):
                n += part.num_rows
                for t in part.column(0).to_pylist():
                    counts[np.unique(read(t))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(counts))), pa.array(np.append(n, counts))], ["at", "n"])

    found = dict(texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
    total = found.pop(-1, 0)
    idf = np.log((total + 1) / (np.array([found.get(i, 0) for i in range(len(vocabulary))], np.float64) + 1))
    idf[vocabulary[OTHER]] = OTHER_IDF
    return idf


def index(vocabulary, idf, examples, prior) -> ToxicityModel:
    """Examples sorted by label and strongest term, so that the weights of a block are alike."""
    def place(r):
        best = int(np.argmax(r["weight"])) if r["weight"] else -1
        return r["label"], r["at"][best] if r["weight"] else -1, str(r["key"])

    rows = sorted(examples, key=place)
    blocks = -(-len(rows) // BLOCK)
    at = np.array([a for r in rows for a in r["at"]], np.int64)
    weight = np.array([w for r in rows for w in r["weight"]], np.float32)
    example = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    n = len(vocabulary)
    cell = example // BLOCK * n + at
    order = np.lexsort((example, cell))
    cell, example, weight = cell[order], example[order], weight[order]
    starts = np.searchsorted(cell, np.arange(blocks * n + 1))
    start = np.stack([starts[b * n: (b + 1) * n + 1] for b in range(blocks)]) if blocks else np.zeros((0, n + 1), np.int64)
    most = np.zeros(blocks * n, np.float32)
    np.maximum.at(most, cell, weight)
    return ToxicityModel(vocabulary, idf, np.array([r["label"] for r in rows], np.int64), [r["key"] for r in rows],
                         start, example, weight, most.reshape(blocks, n).T.copy(), np.asarray(prior, np.float64))


def vote(labels: np.ndarray, sims: np.ndarray, prior: np.ndarray) -> float:
    """Share of toxic votes; a neighbour's vote falls with its squared distance 2 - 2 cos.

    The balanced choice of examples is undone by half (on a log scale): between catching all and sparing all.
    """
    if not len(labels):
        return 0.0
    weight = np.sqrt(prior[labels]) * sims ** SHARPNESS / (2 - 2 * np.minimum(sims, 1) + 0.1)
    return float((weight * labels).sum() / weight.sum())


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep=("doc_id",), out: str = "score",
          evidence: str | None = None) -> DataFrame:
    """``keep`` columns and ``out`` (double, 0 to 1) of every whole text.

    Null and blank texts have no neighbour and score 0, and so does everything under a model without a toxic example. With ``evidence``, a column of
    that name lists the neighbours as ``key:label:cosine``. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        read = _Reader(m.vocabulary)

        def one(text):
            at, weight = _vector(read(text), m.idf)
            if not len(at) or not len(m.labels):
                return 0.0, ""
            found, sims = m.nearest(at, weight, NEIGHBOURS)
            shown = ",".join(f"{m.keys[i]}:{m.labels[i]}:{s:.4f}" for i, s in zip(found, sims)) if evidence else ""
            return vote(m.labels[found], sims, m.prior), shown

        def compute(texts):
            rows = [one(t) for t in texts]
            return [[r[0] for r in rows]] + ([[r[1] for r in rows]] if evidence else [])

        return compute

    columns = [(out, T.DoubleType())] + ([(evidence, T.StringType())] if evidence else [])
    return map_texts(docs, text, keep, columns, start)
