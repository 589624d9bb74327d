"""Helpers shared by the operators: column handling, Arrow maps over texts, bounded word tables."""

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.workspace import written

#: Texts are handed to numpy in slices of at most so many rows or bytes (one longer text is a slice of its own).
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20
#: Classes of so large a part of all rows are joined apart.
HOT = 1000


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` is called so (case does not count)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(modulus))


def held_out(key: str, modulus: int, value: int) -> Column:
    """True for rows kept out of learning: the given remainder, and null keys."""
    return F.coalesce(remainder(key, modulus) == value, F.lit(True))


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of every value of a string or binary column; none for null."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0))


def bounded(batch: pa.RecordBatch, volumes: np.ndarray, rows: int, volume: int):
    """Slices of a batch of at most so many rows and so much volume; one larger row is a slice of its own."""
    at = 0
    ends = np.cumsum(volumes, dtype=np.int64)
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + volume, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def text_slices(batch: pa.RecordBatch, column: int):
    """Slices of a batch with bounded text volume."""
    return bounded(batch, byte_lengths(batch.column(column)), SLICE_ROWS, SLICE_BYTES)


def map_texts(docs: DataFrame, text: str, keep: Sequence[str], out: Sequence[tuple[str, T.DataType]],
              start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The columns ``keep`` of every row and the columns ``out`` computed from its text.

    ``start()`` runs once per task and returns a function from a list of texts (UTF-8 bytes or None) to
    one list or array per output column. Rows are neither moved nor reordered. An input column named like an
    output column is left out.
    """
    made = {n.lower() for n, _ in out}
    keep = [c for c in keep if c.lower() not in made]
    tmp = fresh("text_bytes", [*docs.columns, *made])
    narrow = docs.select(*[col(c) for c in keep], col(text).cast("string").cast("binary").alias(tmp))
    schema = T.StructType([*narrow.schema.fields[:-1], *[T.StructField(n, t) for n, t in out]])
    kinds = [pa.list_(_ARROW[type(t.elementType)]) if isinstance(t, T.ArrayType) else _ARROW[type(t)] for _, t in out]
    names = schema.names

    def run(batches):
        compute = started(start)
        for batch in batches:
            for part in text_slices(batch, len(keep)):
                results = compute(part.column(len(keep)).to_pylist())
                arrays = [pa.array(r, kind) for r, kind in zip(results, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names)

    return narrow.mapInArrow(run, schema)


_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(),
          T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int, seed: int) -> DataFrame:
    """(h, key, t, label) of the different texts among ``rows`` labelled documents per class with the smallest hash.

    The bound is what lets the chosen keys be broadcast, so that no text is shuffled but the chosen ones. Copies and
    most near copies are one text: those whose shingles of five words have the same smallest hash ``h``. Labels other than
    0 and 1, null keys and null texts are left out; a text with both labels counts as 1.
    """
    known = labels.select(col(key).alias("key"), col(label).cast("long").alias("label")).filter("label in (0, 1) and key is not null")
    known = docs.select(col(key).alias("key")).join(known, "key").groupBy("key").agg(F.max("label").alias("label"))
    known = written(known, "known-labels")
    order = F.xxhash64("key", F.lit(seed))
    chosen = [first_rows(known.filter(F.col("label") == c), rows, hashed(order), order, F.col("key")) for c in (0, 1)]
    texts = docs.select(col(key).alias("key"), col(text).cast("string").alias("t")).filter("t is not null")
    picked = texts.join(F.broadcast(chosen[0].union(chosen[1])), "key")
    marked = map_texts(picked.withColumn("text", F.col("t")), "text", ["key", "t", "label"], [("h", T.LongType())],
                       lambda: lambda found: [[least_shingle(t) for t in found]])
    one = Window.partitionBy("h").orderBy(F.desc("label"), "key")
    ranked = marked.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return written(ranked.select("h", "key", F.col("t").cast("binary").alias("t"), "label"), "labelled")


def least_shingle(text: bytes, words: int = 5) -> int:
    """The smallest 64-bit hash of a text's shingles (of the whole text if it has fewer words)."""
    found = text.lower().split()
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found)) >> 1
    return min(xxhash.xxh64_intdigest(b" ".join(found[i:i + words])) for i in range(len(found) - words + 1)) >> 1


def first_rows(df: DataFrame, n: int, bucket: Column, *order: Column) -> DataFrame:
    """The first ``n`` rows of a stored table by ``order``.

    ``bucket`` is a long that never falls along the order and has few values. Their counts tell where the n-th row lies, so
    that only rows up to there are ranked; a plain top-n would send n rows of every task to one place.
    """
    held, last = 0, None
    for b, size in sorted(df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()):
        held, last = held + size, b
        if held >= n:
            break
    return (df.filter(bucket <= last) if last is not None else df).orderBy(*order).limit(n)


def largest(c: Column) -> Column:
    """A bucket for ``first_rows`` in descending order of a number of at least one: sixteen to a power of two."""
    return -F.floor(F.log2(F.greatest(c.cast("double"), F.lit(1.0))) * 16)


def hashed(c: Column) -> Column:
    """A bucket for ``first_rows`` in ascending order of a 64-bit hash: its first twelve bits."""
    return F.shiftright(c, 52).cast("long")


def join_classes(rows: DataFrame, classes: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Equi-join of ``rows`` with unique ``classes`` that names their sizes, safe against classes of any share of the rows.

    Classes of at least a ``HOT`` part of all rows, of which there are no more than ``HOT``, are broadcast; only the rows
    of the others are shuffled.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    limit = max(2, -(-total // HOT))
    hot = F.broadcast(classes.filter(F.col(size) >= limit))
    rest = rows.join(F.broadcast(classes.filter(F.col(size) >= limit).select(*keys)), list(keys), "left_anti")
    both = [rows.join(hot, list(keys)), rest.join(classes.filter(F.col(size) < limit), list(keys))]
    return both[0].unionByName(both[1])


def class_weights(docs: DataFrame, labels: DataFrame, label: str, key: str, chosen: np.ndarray) -> np.ndarray:
    """Vote weights of the classes 0 and 1 that undo a balanced choice of examples; the larger is 1."""
    known = docs.select(col(key).alias("key")).join(labels.select(col(key).alias("key"), col(label).cast("long").alias("c")), "key")
    sizes = dict(known.filter("c in (0, 1)").groupBy("c").count().collect())
    share = np.array([sizes.get(c, 0) / max(1, int((chosen == c).sum())) for c in (0, 1)])
    return share / max(share.max(), 1e-9)


_KEPT: dict = {}


def kept(kind: str, content, make: Callable):
    """An object that the tasks of a Python worker share, made anew when its kind or the content it depends on changes.

    For tables of words already worked out: what they hold depends on the words alone, and their size is bounded. A
    worker keeps one such object at a time, until an operator that needs none runs in it.
    """
    if _KEPT.get("of") != (kind, content):
        _KEPT.clear()
        _KEPT.update(of=(kind, content), made=make())
    _KEPT["used"] = True
    return _KEPT["made"]


def started(start: Callable):
    """``start()``, after which the worker holds nothing that an earlier operator left in it."""
    _KEPT["used"] = False
    compute = start()
    if not _KEPT["used"]:
        _KEPT.clear()
    return compute


class Numbering(dict):
    """Word -> number in order of first sight; ``learn`` is called with every new word.

    ``numbers(words)`` is an array. The table is emptied between texts once it holds ``limit`` words, so a
    task's memory does not grow with the corpus; ``forget`` is called then, and numbering starts again.
    """

    def __init__(self, learn: Callable[[bytes], None], forget: Callable[[], None], limit: int = 400_000):
        super().__init__()
        self.learn, self.forget, self.limit = learn, forget, limit

    def __missing__(self, word):
        self.learn(word)
        self[word] = n = len(self)
        return n

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.clear()
            self.forget()


class Growing:
    """A numpy array that grows by appending; ``values`` is the filled part."""

    def __init__(self, dtype, width: int = 0):
        self.data, self.n = np.empty((1024, width) if width else 1024, dtype), 0

    def append(self, value) -> None:
        if self.n == len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n] = value
        self.n += 1

    def extend(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            more = np.empty((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n:need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.data[: self.n]

    def clear(self) -> None:
        self.n = 0


class Lists:
    """Lists of integers under consecutive numbers, stored flat."""

    def __init__(self, dtype=np.int64):
        self.flat, self.start = Growing(dtype), Growing(np.int64)
        self.start.append(0)

    def append(self, values) -> None:
        self.flat.extend(values)
        self.start.append(self.flat.n)

    def extend(self, flat, sizes) -> None:
        """Several lists, given one after the other and by their sizes."""
        before = self.flat.n
        self.flat.extend(flat)
        self.start.extend(before + np.cumsum(sizes, dtype=np.int64))

    def clear(self) -> None:
        self.flat.clear()
        self.start.n = 1

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The named lists one after the other, and the length of each."""
        start = self.start.values
        first = start[which]
        size = start[which + 1] - first
        total = int(size.sum())
        if not total:
            return self.flat.values[:0], size
        before = np.cumsum(size) - size
        return self.flat.values[np.repeat(first - before, size) + np.arange(total)], size
