"""Vectors dealt to cells around pivots: an index whose parts a search can leave out by the triangle inequality."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.workspace import release, written

#: Pivots are chosen from so many vectors, of so many bytes in all; their number is the root of the number
#: of vectors, within these bounds. So many lengths of vector, the most frequent, get pivots.
SAMPLE, SAMPLE_BYTES, MOST_PIVOTS, PIVOT_BYTES, LENGTHS = 20_000, 16 << 20, 1024, 16 << 20, 8
#: Vectors of a chunk, at least; it grows with the index so that there are no more than MOST_CHUNKS.
CHUNK_ROWS, MOST_CHUNKS = 4096, 1 << 18
#: Chunks of a stored file.
FILE_ROWS = 16

CHUNK = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
    T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("vectors", T.BinaryType()),
])
PIVOT = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("pivot", T.ArrayType(T.DoubleType()))])


def comparable(c: Column) -> Column:
    """True for a vector of finite numbers; false for a null or empty one and for one with a null, NaN or infinity."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(c) > 0), F.lit(False))


class Cells:
    """``chunks`` (chunk, dim, cell, low, high, n, ids, vectors): up to some thousand vectors of one cell, whose distances
    from the pivot lie between ``low`` and ``high``. ``pivots``: the pivots of each length of vector, of bounded volume.
    ``packs``: chunks side by side, while a search keeps them stored."""

    def __init__(self, chunks: DataFrame, pivots: dict[int, np.ndarray]):
        self.chunks, self.pivots, self.packs, self._listed = chunks, pivots, None, None

    def write(self, path: str) -> None:
        flat = [(int(dim), c, [float(x) for x in v]) for dim, matrix in self.pivots.items() for c, v in enumerate(matrix)]
        self.chunks.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/chunks")
        self.chunks.sparkSession.createDataFrame(flat, PIVOT).write.mode("overwrite").parquet(f"{path}/pivots")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Cells":
        found: dict = {}
        for row in spark.read.schema(PIVOT).parquet(f"{path}/pivots").orderBy("dim", "cell").collect():
            found.setdefault(row["dim"], []).append(row["pivot"])
        return Cells(spark.read.schema(CHUNK).parquet(f"{path}/chunks"), {dim: np.array(rows) for dim, rows in found.items()})

    def release(self) -> None:
        """Delete the chunks if ``build_cells`` stored them."""
        release(self.chunks)

    def listed(self) -> dict[int, tuple]:
        """(chunk, cell, low, high, n) of all chunks of each length, by cell and distance: their number is bounded (MOST_CHUNKS,
        and a rest for each cell and task)."""
        if self._listed is None:
            rows = self.chunks.select("dim", "cell", "low", "chunk", "high", "n").toPandas().sort_values(["dim", "cell", "low", "chunk"])
            self._listed = {int(dim): tuple(own[c].to_numpy() for c in ("chunk", "cell", "low", "high", "n")) for dim, own in rows.groupby("dim")}
        return self._listed


def _geometry():
    """Numpy helpers as closures, shipped by value: executors need only numpy and pyarrow."""
    import numpy as np
    import pyarrow as pa

    def distances(vectors, pivots):
        """All distances, from differences in slices of pivots: no cancellation, bounded memory."""
        out = np.empty((len(vectors), len(pivots)))
        step = max(1, (1 << 22) // max(1, vectors.size))
        for a in range(0, len(pivots), step):
            gap = vectors[:, None, :] - pivots[None, a:a + step, :]
            out[:, a:a + step] = np.sqrt((gap * gap).sum(axis=2))
        return out

    def nearest_pivot(vectors, pivots):
        """(cell, distance) of every vector; screened by a product, the distance of the chosen one is exact."""
        cell, reach = np.empty(len(vectors), np.int32), np.empty(len(vectors))
        half = 0.5 * (pivots * pivots).sum(axis=1)
        for a in range(0, len(vectors), 2048):
            part = vectors[a:a + 2048]
            near = (half - part @ pivots.T).argmin(axis=1)
            gap = part - pivots[near]
            cell[a:a + 2048], reach[a:a + 2048] = near, np.sqrt((gap * gap).sum(axis=1))
        return cell, reach

    def by_length(column):
        """(length, rows, matrix) for every length of vector in a list column."""
        sizes = np.asarray(column.value_lengths())
        for size in np.unique(sizes):
            rows = np.nonzero(sizes == size)[0]
            vectors = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            yield int(size), rows, vectors.astype(np.float64).reshape(len(rows), -1)

    return distances, nearest_pivot, by_length


def deal(vectors: DataFrame, key: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(key, dim, cell, reach, embedding): every comparable vector with its nearest pivot and the distance from it.

    Vectors of a length without pivots are all in cell 0, with distance 0.
    """
    _, nearest_pivot, by_length = _geometry()
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    narrow = vectors.filter(comparable(F.col("embedding"))).select(key, "embedding")
    schema = T.StructType([
        narrow.schema[key], T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
        T.StructField("reach", T.DoubleType()), narrow.schema["embedding"]])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims, cells, reaches = (np.zeros(batch.num_rows, kind) for kind in (np.int32, np.int32, np.float64))
            for dim, rows, matrix in by_length(batch.column(1)):
                dims[rows] = dim
                if dim in shared.value:
                    cells[rows], reaches[rows] = nearest_pivot(matrix, shared.value[dim])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(cells), pa.array(reaches), batch.column(1)], schema.names)

    return narrow.mapInArrow(run, schema)


def _choose_pivots(vectors: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Pivots for the frequent lengths of vector, and the number of vectors.

    Only speed depends on them, so they come from a sample of bounded size whatever the index holds (different vectors
    with the smallest hashes): the centres of a few rounds of k-means.
    """
    counts = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted(((r["n"], r["dim"]) for r in counts.collect()), reverse=True)
    h, share = F.xxhash64("embedding"), F.lit(-1)
    most = {dim: min(SAMPLE, SAMPLE_BYTES // (8 * dim * min(LENGTHS, len(sizes))) + 1) for _, dim in sizes[:LENGTHS]}
    for n, dim in sizes[:LENGTHS]:
        share = F.when(F.size("embedding") == dim, int(min(1.0, 1.2 * most[dim] / n) * (1 << 30))).otherwise(share)
    sample = vectors.filter(F.pmod(h, F.lit(1 << 30)) <= share).groupBy(h.alias("h")).agg(
        F.any_value("embedding").alias("v")).toArrow().sort_by("h")  # as Arrow: no Python numbers
    _, _, by_length = _geometry()
    points = {dim: matrix[:most[dim]] for dim, _, matrix in by_length(sample.column("v").combine_chunks())}
    found = {}
    for n, dim in sizes[:LENGTHS]:
        matrix = points.get(dim, ())
        if len(matrix):
            found[dim] = _centres(matrix, max(1, min(MOST_PIVOTS, int(n ** 0.5), PIVOT_BYTES // (8 * dim), len(matrix))))
    total = sum(n for n, _ in sizes)
    return found, total


def _centres(points: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Centres of k groups of points by k-means."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        half = 0.5 * (centres * centres).sum(axis=1)
        near = np.concatenate([(half - points[a:a + 2048] @ centres.T).argmin(axis=1) for a in range(0, len(points), 2048)])
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return centres


def build_cells(index: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Cells:
    """Deal the rows (doc_id, embedding) of an index to cells, stored in the shared folder.

    A vector belongs to its nearest pivot. Vectors are range-partitioned by (length, cell, distance, id), so a cell that holds a
    third of all vectors, or as many copies of one, is spread over tasks like any other range; each task
    packs what it gets into chunks of one cell. Vectors that cannot be compared (null, empty, not finite) are left out.
    """
    vectors = index.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter(comparable(F.col("embedding")))
    single = index.schema["embedding"].dataType.elementType == T.FloatType()
    pivots, total = _choose_pivots(vectors)
    rows = max(chunk_rows, -(-total // MOST_CHUNKS))
    dealt = deal(vectors, "doc_id", pivots)
    order = ["dim", "cell", "reach", "doc_id"]

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = None

        def chunk(table):
            nonlocal number
            number += 1
            flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            reach = table.column("reach")
            return (number, table.column("dim")[0].as_py(), table.column("cell")[0].as_py(), reach[0].as_py(), reach[-1].as_py(),
                    table.num_rows, table.column("doc_id").combine_chunks(), np.ascontiguousarray(flat, "<f4" if single else "<f8").tobytes())

        def out(parts):
            columns = list(zip(*parts))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(columns[5])).astype(np.int32)), pa.concat_arrays(columns[6]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds)], lists, pa.array(columns[7], pa.binary())], CHUNK.names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = np.asarray(held.column("dim")).astype(np.int64) << 32 | np.asarray(held.column("cell"))
            edges = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)).tolist()
            at = 0
            for a, b in zip(edges[:-1], edges[1:]):
                at = a
                while b - at >= rows or (b < len(key) and b > at):
                    n = min(rows, b - at)
                    yield out([chunk(held.slice(at, n))])
                    at += n
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield out([chunk(held)])

    return Cells(written(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, CHUNK), "chunks", FILE_ROWS, "none"), pivots)
