"""Text encoders: a hashed TF-IDF default and a hook for model encoders."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.functions.text import WS
from tamhis.workspace import small_buffers, written


def lower_words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), f"{WS}++"), "")


def _hashing(dim: int, limit: int = 400_000):
    """Arrow helper as a closure, shipped by value: lists of words -> (row, bucket) of every word.

    A word's bucket is the first 16 bits of its md5 modulo ``dim``. Each distinct word is hashed once for all batches of
    a task, as long as no more than ``limit`` are known.
    """
    from hashlib import md5

    class Buckets(dict):
        def __missing__(self, word):
            self[word] = bucket = int(md5(word.encode()).hexdigest()[:4], 16) % dim
            return bucket

    known = Buckets()

    def row_and_bucket(words: pa.Array):
        coded = words.flatten().dictionary_encode()
        if len(known) > limit:
            known.clear()
        bucket = np.fromiter(map(known.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        return row, bucket[coded.indices.to_numpy()]

    return row_and_bucket


#: Dense vectors that are made at a time, in bytes.
SLICE_BYTES = 2 << 20


class TfidfEncoder:
    """Hashed TF-IDF vectors of unit length; a text without words gets the zero vector.

    Texts are split in the JVM and counted in Arrow batches, once: ``counts`` adds the sparse (bucket, tf) list of each
    text, from which ``fit_counts`` learns (``dim`` numbers reach the driver) and ``weights`` computes, both on
    built-in functions. Store the counts to use them twice. ``fit`` and ``encode`` do it all for a text column.
    """

    def __init__(self, dim: int = 256):
        if not 1 <= dim <= 65536:
            raise ValueError("dim must be between 1 and 65536")
        self.dim = dim
        self.idf = None

    def counts(self, df: DataFrame, column: str, out: str = "tf") -> DataFrame:
        """Add ``out``: array of (bucket, n), buckets ascending."""
        dim, row_and_bucket = self.dim, _hashing(self.dim)

        def count(words: pa.Array) -> pa.Array:
            row, bucket = row_and_bucket(words)
            cells, n = np.unique(row * dim + bucket, return_counts=True)
            offsets = np.searchsorted(cells, np.arange(len(words) + 1) * dim).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array((cells % dim).astype(np.int32)), pa.array(n.astype(np.int32))], ["bucket", "n"])
            return pa.ListArray.from_arrays(offsets, pairs)

        counted = F.arrow_udf(count, returnType="array<struct<bucket:int,n:int>>")
        return df.withColumn(out, counted(lower_words(F.col(column))))

    def fit_counts(self, df: DataFrame, column: str = "tf") -> "TfidfEncoder":
        present = F.concat(F.array(F.lit(-1)), F.transform(column, lambda x: x["bucket"]))
        with small_buffers(df.sparkSession):
            found = dict(df.select(F.explode(present).alias("b")).groupBy("b").agg(F.count(F.lit(1))).collect())
        n = found.pop(-1, 0)
        df_of = np.array([found.get(b, 0) for b in range(self.dim)], dtype=np.float64)
        self.idf = np.log((n + 1.0) / (df_of + 1.0))
        return self

    def weights(self, df: DataFrame, column: str = "tf", out: str = "weights") -> DataFrame:
        """Add ``out``: array of (bucket, weight) of a unit vector, from the counts."""
        if self.idf is None:
            raise ValueError("fit the encoder first")
        idf = F.array(*[F.lit(float(x)) for x in self.idf]) if self.dim <= 1024 else None
        if idf is None:  # too long for a literal
            table = df.sparkSession.createDataFrame([(self.idf.tolist(),)], "idf array<double>")
            df, idf = df.withColumn("_idf", table.scalar()), F.col("_idf")
        raw = df.withColumn(out, F.transform(column, lambda x: F.struct(
            x["bucket"].alias("bucket"), (x["n"] * F.element_at(idf, x["bucket"] + 1)).alias("weight"))))
        # the norm goes in as an array: named inside the lambda, it would be computed again for every entry
        norm = F.sqrt(F.aggregate(out, F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
        scaled = F.zip_with(out, F.array_repeat(norm, F.size(out)), lambda x, n: F.struct(
            x["bucket"].alias("bucket"), F.when(n > 0, x["weight"] / n).otherwise(0.0).alias("weight")))
        return raw.withColumn(out, scaled).drop("_idf")

    def dense(self, df: DataFrame, column: str = "weights", out: str = "embedding") -> DataFrame:
        """Replace the sparse weights by ``out`` (array of double), a bounded slice of rows at a time."""
        rows, dim = max(1, SLICE_BYTES // (8 * self.dim)), self.dim
        rest = [c for c in df.columns if c != column]
        narrow = df.select(*rest, F.transform(column, lambda x: x["bucket"]).alias("_bucket"),
                           F.transform(column, lambda x: x["weight"]).alias("_weight"))
        schema = T.StructType([*narrow.schema.fields[:-2], T.StructField(out, T.ArrayType(T.DoubleType()))])
        names = schema.names

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for k in range(0, batch.num_rows, rows):
                    part = batch.slice(k, rows)
                    bucket, weight = part.columns[-2:]
                    n = part.num_rows
                    matrix = np.zeros((n, dim))
                    sizes = np.diff(bucket.offsets.to_numpy())
                    matrix[np.repeat(np.arange(n), sizes), bucket.flatten().to_numpy()] = weight.flatten().to_numpy()
                    vectors = pa.ListArray.from_arrays(np.arange(0, (n + 1) * dim, dim, dtype=np.int32), matrix.ravel())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], vectors], names)

        return narrow.mapInArrow(run, schema)

    def fit(self, df: DataFrame, column: str) -> "TfidfEncoder":
        return self.fit_counts(self.counts(df.select(column), column, "tf"))

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``embedding`` (array of double)."""
        return self.dense(self.weights(self.counts(df, column, "_tf"), "_tf", "_weights").drop("_tf"), "_weights")


#: Texts that are gathered and sorted by length before they go to a model: so many rows or characters.
WINDOW_ROWS, WINDOW_CHARS = 4096, 8 << 20
#: Texts of at least a COMMON part of all rows (there are no more than COMMON) get their vectors by broadcast.
COMMON = 1000


class BatchEncoder:
    """Any model encoder: ``make()`` returns a function from a list of texts to a list (or matrix) of vectors.

    ``make`` runs once per task, on the executor, so the model is loaded there and used for all batches of the task. The
    model gets ``batch`` texts at a time, of similar length: texts are gathered in a bounded window and sorted by
    length, so that a model which pads its batches pads little. With ``arrow`` it gets an Arrow array of
    strings instead of a list; a matrix or an Arrow list array is taken over as it is, without a Python number.
    """

    def __init__(self, make, batch: int = 64, arrow: bool = False):
        self.make, self.batch, self.arrow = make, batch, arrow

    def vectors(self, texts: DataFrame, column: str) -> DataFrame:
        """``texts`` with ``embedding`` in place of their text, in any order; the other columns must be simple."""
        make, size, arrow, rows, chars = self.make, self.batch, self.arrow, WINDOW_ROWS, WINDOW_CHARS
        narrow = texts.select(*[c for c in texts.columns if c != column], column)
        schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("embedding", T.ArrayType(T.FloatType()))])
        names = schema.names

        def listed(found):
            import numpy as np
            import pyarrow as pa

            kind = pa.list_(pa.float32())
            if isinstance(found, (pa.Array, pa.ChunkedArray)):
                found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
                return found.cast(kind)
            if not isinstance(found, np.ndarray) and len({len(v) for v in found}) > 1:
                return pa.array([np.asarray(v, np.float32) for v in found], kind)
            matrix = np.ascontiguousarray(found, np.float32)
            matrix = matrix.reshape(len(matrix), -1)
            return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)[:len(matrix) + 1]
                                            if matrix.shape[1] else np.zeros(len(matrix) + 1, np.int32), matrix.ravel())

        def windows(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            held, n, volume = [], 0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    held.append(part)
                    n, volume = n + part.num_rows, volume + (pc.sum(pc.utf8_length(part.columns[-1])).as_py() or 0)
                    if n >= rows or volume >= chars:
                        yield pa.Table.from_batches(held).combine_chunks()
                        held, n, volume = [], 0, 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks()

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            model = make()
            for window in windows(batches):
                window = window.take(pc.sort_indices(pc.utf8_length(window.columns[-1]))).combine_chunks()
                for part in window.to_batches(max_chunksize=size):
                    own = part.columns[-1]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], listed(model(own if arrow else own.to_pylist()))], names)

        return narrow.mapInArrow(run, schema)

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        """Add ``embedding`` (array of float); null counts as the empty text.

        Each distinct text, told by its 128-bit digest, is encoded once and its vector stored in the shared folder; the
        rows get the vectors by a join, so columns of any type pass by Python. Vectors of the most common texts are
        broadcast, and their rows take no part in the shuffle's keys: copies cost neither the model nor one task anything.
        """
        df = df.drop("embedding")
        keyed = df.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")))))
        texts = keyed.groupBy("_key").agg(F.any_value(F.coalesce(F.col(column), F.lit(""))).alias("_text"), F.count(F.lit(1)).alias("_n"))
        found = written(self.vectors(texts, "_text"), "vectors")
        total = found.agg(F.sum("_n")).first()[0] or 0
        common = found.filter(F.col("_n") >= max(2, -(-total // COMMON))).select("_key", F.col("embedding").alias("_common"))
        # a row that has its vector gets a key of its own, which matches nothing and lies anywhere
        own = F.unhex(F.md5(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))))
        known = keyed.join(F.broadcast(common), "_key", "left").withColumn("_key", F.when(F.col("_common").isNull(), F.col("_key")).otherwise(own))
        return known.join(found.drop("_n"), "_key", "left").select(*df.columns, F.coalesce("_common", "embedding").alias("embedding"))
