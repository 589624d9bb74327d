"""Language identification by word frequencies with backoff to character n-grams."""

import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import Growing, Numbering, col, first_rows, fresh, join_classes, kept, largest, map_texts, text_slices
from tamhis.workspace import written

MAX_LANGUAGES = 256
#: Words whose scores are broadcast, the most frequent ones; those of all others are joined.
BROADCAST_WORDS = 50_000
LONGEST_GRAM = 4
SMOOTHING = 0.5
#: Different words of a language that a counting task holds before it hands them on.
TASK_WORDS = 500_000
#: Different words whose scores a Python worker keeps.
WORDS_HELD = 600_000
UNDETERMINED = "und"


def word_key(word: bytes) -> str:
    """A word as it is looked up: lower case, without characters that are no letters at its ends."""
    s = word.decode("utf-8", "replace").lower()
    if s.isalpha():
        return s
    letters = [i for i, c in enumerate(s) if c.isalpha()]
    return s[letters[0]: letters[-1] + 1] if letters else ""


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """All words and n-grams as stored tables (key, a count per language named c0, c1, ..), and their sums.

    The properties and ``scores`` bring whole tables to the driver: they are for looking at small models.
    """

    languages: list[str]
    word_counts: DataFrame | None = None
    word_sums: tuple = ()  # (entries, sums by language)
    gram_counts: DataFrame | None = None
    gram_sums: tuple = ()

    def _collected(self, table, sums):
        found = sorted(table.collect()) if self.languages else []
        counts = np.array([r[1:] for r in found], np.float64).reshape(-1, len(self.languages))
        return {r[0]: i for i, r in enumerate(found)}, _logs(counts, sums)

    @cached_property
    def _words(self):
        return self._collected(self.word_counts, self.word_sums)

    @cached_property
    def _grams(self):
        return self._collected(self.gram_counts, self.gram_sums)

    words = property(lambda self: self._words[0])
    word_logs = property(lambda self: self._words[1])
    grams = property(lambda self: self._grams[0])
    gram_logs = property(lambda self: self._grams[1])

    def scores(self, word: str) -> np.ndarray:
        """Log frequency of a word per language.

        A known word has its own; an unseen one the mean over its known n-grams of the greatest length of
        which any is known; without any, or without a letter, it says nothing.
        """
        row = self.words.get(word)
        if row is not None:
            return self.word_logs[row]
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if known:
                return np.add.reduce(self.gram_logs[known]) / len(known)
        return np.zeros(len(self.languages), np.float32)


def _logs(counts: np.ndarray, sums: tuple) -> np.ndarray:
    if not sums:
        return np.zeros(counts.shape, np.float32)
    return np.log((counts + SMOOTHING) / (np.array(sums[1]) + SMOOTHING * max(1, sums[0]))).astype(np.float32)


def _log_columns(sums: tuple) -> list:
    """The same as columns l0, l1, .. of a table with counts."""
    return [F.log((F.col(f"c{i}") + SMOOTHING) / F.lit(float(x + SMOOTHING * max(1, sums[0])))).cast("float").alias(f"l{i}")
            for i, x in enumerate(sums[1])]


def _count_words(batches):
    """(lang, word, n) of a task, handed on whenever a bounded table is full."""
    def flush():
        rows = [(lang, w, n) for lang, table in counts.items() for w, n in table.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.binary()), (2, pa.int64()))],
            ["lang", "word", "n"])

    counts = {}
    for batch in batches:
        for part in text_slices(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                table = counts.setdefault(lang, {})
                get = table.get
                for w in text.split():
                    table[w] = get(w, 0) + 1
            if sum(map(len, counts.values())) >= TASK_WORDS:
                yield flush()
    if counts:
        yield flush()


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows whose text and language are not null.

    Words are counted over all of them (combined in the tasks before the shuffle), n-grams over the table of
    different words. Every word and n-gram is kept, in stored tables; the driver gets sums only. Repeated rows count
    as often as they occur; more than ``MAX_LANGUAGES`` languages are an error; an empty table gives a model without
    languages.
    """
    rows = train.select(col(lang).cast("string").alias("lang"), col(text).cast("string").cast("binary").alias("t")).dropna()
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return LanguageModel([])
    names = [f"c{i}" for i in range(len(languages))]

    def counted(df, key):
        return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])

    raw = rows.mapInArrow(_count_words, "lang string, word binary, n long")
    split = raw.select("word", *[F.when(F.col("lang") == L, F.col("n")).otherwise(0).alias(c) for c, L in zip(names, languages)])
    # raw spellings are joined to keys after a first count, so that each is handled in Python once
    table = written(_keyed(counted(split, "word"), names), "language-counts")
    model = [languages]
    for kind, name in (("gram = 0", "language-words"), ("gram > 0", "language-grams")):
        whole = written(counted(table.filter(kind), "key"), name)
        entries, *sums = whole.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
        model += [whole, (entries, sums)]
    return LanguageModel(*model)


def _keyed(spelled: DataFrame, names) -> DataFrame:
    """(key, gram, counts): the looked-up form of every spelling (gram 0) and its n-grams (1), summed up per batch."""
    def rows(keys, kind, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(np.full(len(keys), kind)), *[pa.array(c) for c in counts.T.copy()]],
            ["key", "gram", *names])

    def run(batches):
        for batch in batches:
            counts = np.stack([np.asarray(c, np.int64) for c in batch.columns[1:]], axis=1)
            keys = [word_key(w) for w in batch.column(0).to_pylist()]
            usable = np.array([i for i, k in enumerate(keys) if k], np.int64)
            keys, counts = [k for k in keys if k], counts[usable]
            number, ids, sizes = {}, [], []
            for key in keys:
                own = [g for n in range(1, min(LONGEST_GRAM, len(key) + 2) + 1) for g in grams(key, n)]
                ids += [number.setdefault(g, len(number)) for g in own]
                sizes.append(len(own))
            of = np.repeat(np.arange(len(keys)), sizes)
            sums = [np.bincount(ids, counts[of, i], len(number)) for i in range(len(names))] if keys else []
            if keys:
                yield rows(keys, 0, counts)
                yield rows(list(number), 1, np.stack(sums, axis=1).astype(np.int64))

    return spelled.mapInArrow(run, ", ".join(["key string", "gram long", *[f"{c} long" for c in names]]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred (string) and score (its posterior probability) of every whole text.

    A null text, a text without a letter, and any text under a model without languages are ``und`` with score 0.
    Ties go to the language that sorts first. Rows are independent; repeated rows get equal results.

    A first pass adds up the scores of the most frequent words and lists a text's other words; the scores of those are
    worked out once per different word, by joins with the whole model, and added by row. Scores of words are in single
    precision and their sums in double, so the order of adding does not matter.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    languages = model.languages
    if not languages:
        return docs.select(*[col(c) for c in keep], F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    counts = [F.col(f"c{i}") for i in range(len(languages))]
    total = sum(counts[1:], counts[0])
    head = first_rows(model.word_counts, BROADCAST_WORDS, largest(total), F.desc(total), F.col("key")).collect()
    head_logs = _logs(np.array([r[1:] for r in head], np.float64).reshape(-1, len(languages)), model.word_sums)
    shared = docs.sparkSession.sparkContext.broadcast(({r[0]: i for i, r in enumerate(head)}, head_logs))
    token = uuid.uuid4().hex  # tells this model's tables from another's

    def table():
        rows, logs_of = shared.value
        logs, place, others, names = Growing(np.float32, width=len(languages)), Growing(np.int64), {}, []

        def learn(word):
            key = word_key(word)
            row = rows.get(key) if key else None
            logs.append(0 if row is None else logs_of[row])
            # 0 and up: number of a word that is joined; -1: a broadcast word; -2: no letter
            place.append(-2 if not key else -1 if row is not None else others.setdefault(key, len(others)))
            if len(others) > len(names):
                names.append(key)

        def forget():
            for x in (logs, place, others, names):
                x.clear()

        return logs, place, names, Numbering(learn, forget, WORDS_HELD)

    def start():
        logs, place, names, words = kept("language scores", token, table)

        def compute(texts):
            sums, lettered, keys, sizes = [], [], [], []
            for t in texts:
                words.trim()
                numbers = words.numbers(t.split()) if t else np.empty(0, np.int64)
                at = place.values[numbers]
                sum_of = np.zeros(len(languages))
                for k in range(0, len(numbers), 65536):
                    sum_of += logs.values[numbers[k:k + 65536]].sum(axis=0, dtype=np.float64)
                which, n = np.unique(at[at >= 0], return_counts=True)
                sums.append(sum_of)
                lettered.append(bool((at > -2).any()))
                keys.append([names[i] for i in which.tolist()])
                sizes.append(n)
            return [sums, lettered, keys, sizes]

        return compute

    made = {n: fresh(n, [*keep, "lang_pred", "score"]) for n in ("sums", "lettered", "words", "sizes", "row")}
    sums, lettered, others, sizes, row = made.values()
    rows = map_texts(docs, text, keep, [(sums, T.ArrayType(T.DoubleType())), (lettered, T.BooleanType()),
                                        (others, T.ArrayType(T.StringType())), (sizes, T.ArrayType(T.LongType()))], start)
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "language-rows")
    joined = rows.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(others).alias("key"), F.col(sizes).alias("n"))).alias("p"))
    joined = joined.select("row", "p.key", "p.n")
    scores = _scores(joined.groupBy("key").agg(F.count("*").alias("size")), model)
    logs = [f"l{i}" for i in range(len(languages))]
    added = join_classes(joined, scores, ["key"], "size").groupBy("row").agg(
        *[F.sum(F.col("n") * F.col(c).cast("double")).alias(c) for c in logs])
    added = added.select(F.col("row").alias(row), F.array(*logs).alias("added"))
    more = fresh("added", rows.columns)
    found = rows.join(added.withColumnRenamed("added", more), row, "left")
    whole, best = fresh("whole", found.columns), fresh("best", found.columns)
    found = found.withColumn(whole, F.when(F.col(more).isNull(), F.col(sums)).otherwise(F.zip_with(sums, more, lambda a, b: a + b)))
    found = found.withColumn(best, F.array_max(whole))
    posterior = 1 / F.aggregate(whole, F.lit(0.0), lambda a, x: a + F.exp(x - F.col(best)))
    name = F.element_at(F.array(*[F.lit(n) for n in languages]), F.array_position(whole, F.col(best)).cast("int"))
    return found.select(*[col(c) for c in keep], F.when(F.col(lettered), name).otherwise(UNDETERMINED).alias("lang_pred"),
                        F.when(F.col(lettered), posterior).otherwise(0.0).alias("score"))


def _scores(asked: DataFrame, model: LanguageModel) -> DataFrame:
    """(key, size, l0, l1, ..) of the different words ``asked`` (key, size) that the model says something about."""
    asked = written(asked, "language-asked")
    known = asked.join(model.word_counts, "key").select("key", "size", *_log_columns(model.word_sums))
    parts = [known]
    left = asked.join(model.word_counts, "key", "left_anti")
    logs = [f"l{i}" for i in range(len(model.languages))]
    for n in range(LONGEST_GRAM, 0, -1):
        left = written(left, "language-unseen")
        if left.isEmpty():
            break
        pieces = left.select("key").mapInArrow(_pieces(n), "key string, gram string")
        of = pieces.groupBy("gram").agg(F.count("*").alias("asks")).join(
            model.gram_counts.withColumnRenamed("key", "gram"), "gram").select("gram", "asks", *_log_columns(model.gram_sums))
        means = join_classes(pieces, written(of, "language-pieces"), ["gram"], "asks").groupBy("key").agg(
            *[F.avg(F.col(c).cast("double")).cast("float").alias(c) for c in logs])
        parts.append(written(left.join(means, "key"), "language-means"))
        left = left.join(parts[-1].select("key"), "key", "left_anti")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part.select(out.columns))
    return written(out, "language-scores")


def _pieces(n):
    """(key, gram): the n-grams of words."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                words = batch.column(0).slice(k, 4096).to_pylist()
                found = [grams(w, n) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, own in zip(words, found) for _ in own], pa.string()),
                     pa.array([g for own in found for g in own], pa.string())], ["key", "gram"])

    return run
