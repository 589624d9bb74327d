"""Exact nearest neighbours by Euclidean distance, over the cells of an index."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.operators.cells import Cells, _geometry, build_cells, comparable, deal
from tamhis.workspace import release, settings, small_buffers, written

#: Queries of a block have at most so many bytes.
BLOCK_BYTES = 1 << 20
#: Differences of vectors that are computed at a time, in bytes.
GAP_BYTES = 4 << 20
#: Vectors of the index, and queries, that meet in one step of the second job have at most so many bytes; less where that
#: leaves fewer than two packs for a core, but no less than the smallest number.
PACK_BYTES, ASKED_BYTES, LEAST_PACK = 4 << 20, 8 << 20, 1 << 20
#: Bytes of either that a task reads: a query has hits in every part of the index, so there are no more parts than needed.
LEAST_PART, MOST_PART = 16 << 20, 64 << 20


def _top_k(k):
    """Numpy kernel as closures, which are shipped by value: executors need only numpy and pyarrow.

    ``merge(best, queries, ids, vectors)`` folds a block of documents into the running k best
    (distance, id) per query. Distances are screened by one matrix product, in single precision with its error
    bound where that tells them apart, and recomputed exactly for the few pairs that can still enter, so ties are
    broken by id on exact values.
    """
    import numpy as np
    import pyarrow as pa

    last = np.iinfo(np.int64).max
    tile, gap_bytes = 1024, GAP_BYTES

    def start(n):
        return np.full((n, k), np.inf), np.full((n, k), last, dtype=np.int64)

    def first_copies(ids, vectors):
        """Mask of the k smallest ids of each distinct vector; ties go to the smaller id, so no other copy
        can be among the k nearest of any query."""
        packed = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
        group = np.unique(packed, return_inverse=True)[1]
        order = np.lexsort((ids, group))
        place = np.arange(len(ids)) - np.searchsorted(group[order], group[order])
        mask = np.empty(len(ids), dtype=bool)
        mask[order] = place < k
        return mask

    def side(vectors, centre, kind, scale):
        """(vectors from the centre, scaled, with a column of ones; |v|^2 of those not scaled), in slices."""
        out, norms = np.empty((len(vectors), vectors.shape[1] + 1), kind), np.empty(len(vectors))
        for a in range(0, len(vectors), tile):
            moved = vectors[a:a + tile] - centre
            norms[a:a + tile] = np.einsum("ij,ij->i", moved, moved)
            out[a:a + tile, :-1] = moved * scale
        out[:, -1] = 1
        return out, norms

    def merge(best, queries, ids, vectors):
        dist, who = best
        dim, centre = queries.shape[1], vectors.mean(axis=0)
        # far above the rounding error of a product, relative to |q|^2 + |v|^2
        fine, rough = 1e-9, (dim + 16) * 2.0 ** -22
        most = max(np.abs(queries).max(initial=0.0), np.abs(vectors).max(initial=0.0))
        shift = 1e-12 + 1e-13 * dim * most * most  # what moving the origin to the vectors' middle may change
        kinds = [(np.float32, rough)] if rough < 1e-2 and most < 1e12 else []
        kinds.append((np.float64, fine))
        asked: dict = {}

        def screened(v0, part, kind, eps):
            """Pairs whose product does not rule them out. probes . targets = |v|^2 - 2qv - eps |v|^2: a lower bound of the
            squared distance without the query's own part."""
            if kind not in asked:
                asked[kind] = side(queries, centre, kind, -2.0)
            if (kind, v0) not in found:
                targets, v_norm = side(vectors[v0:v0 + tile], centre, kind, 1.0)
                targets[:, -1] = (1.0 - eps) * v_norm
                found[kind, v0] = targets.T, v_norm.max()
            (probes, q_norm), (targets, v_most) = asked[kind], found[kind, v0]
            low = probes[part] @ targets
            limit = dist[part, -1] ** 2 - (1.0 - eps) * q_norm[part] + shift
            open_ = np.isinf(limit)
            if open_.any() and low.shape[1] >= k:
                kth = np.partition(low[open_], k - 1, axis=1)[:, k - 1]
                limit[open_] = kth + (2.0 * eps * (q_norm[part][open_] + v_most) + shift)
            if kind is np.float32:
                limit = np.nextafter(limit.astype(kind), kind(np.inf))
            pairs = np.flatnonzero(low <= limit[:, None])  # flat, because numpy skips its zeros faster
            return low, *np.divmod(pairs, low.shape[1])

        for v0 in range(0, len(ids), tile):
            useful, found = None, {}
            for q0 in range(0, len(queries), tile):
                part = slice(q0, q0 + tile)
                for kind, eps in kinds:
                    low, qi, vi = screened(v0, part, kind, eps)
                    if len(qi) <= max(64, 2 * k * len(low), low.size // 64):
                        break  # single precision tells them apart
                if len(qi) > 8 * k * len(low):  # many ties: most are copies that cannot enter
                    if useful is None:
                        useful = first_copies(ids[v0:v0 + tile], vectors[v0:v0 + tile])
                    qi, vi = qi[useful[vi]], vi[useful[vi]]
                if not len(qi):
                    continue
                exact = np.empty(len(qi))
                step = max(1, gap_bytes // (8 * queries.shape[1]))
                for p0 in range(0, len(qi), step):
                    some = slice(p0, p0 + step)
                    gap = queries[q0 + qi[some]] - vectors[v0 + vi[some]]
                    exact[some] = np.sqrt((gap * gap).sum(axis=1))
                touched = np.unique(qi)
                rows = np.concatenate([qi, np.repeat(touched, k)])
                d = np.concatenate([exact, dist[q0 + touched].ravel()])
                i = np.concatenate([ids[v0 + vi], who[q0 + touched].ravel()])
                order = np.lexsort((i, d, rows))
                rows, d, i = rows[order], d[order], i[order]
                first = np.searchsorted(rows, touched)
                pick = first[:, None] + np.arange(k)[None, :]
                dist[q0 + touched] = d[pick]
                who[q0 + touched] = i[pick]

    def by_length(ids, column):
        """(length, ids, matrix) for every length of vector in a list column."""
        sizes = np.diff(column.offsets.to_numpy())
        for size in np.unique(sizes):
            rows = np.nonzero(sizes == size)[0]
            vectors = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            yield int(size), rows, ids[rows], vectors.astype(np.float64).reshape(len(rows), -1)

    def rows(best, query_ids):
        dist, who = best
        keep = np.isfinite(dist)
        return {"query_id": query_ids.take(pa.array(np.nonzero(keep)[0])), "doc_id": who[keep], "distance": dist[keep]}

    return start, merge, by_length, rows


def left_out(vectors: DataFrame) -> DataFrame:
    """One row: how many rows of an index or of queries have no comparable vector."""
    return vectors.agg(F.count(F.when(~comparable(F.col("embedding")), 1)).alias("n_left_out"))


def _blocks(queries: DataFrame, pivots: dict, block_bytes: int) -> DataFrame:
    """(block, dim, keys, cells, reaches, vectors): queries of one length, neighbours together."""
    dealt = deal(queries, "query_id", pivots)
    order = [F.col("dim"), F.col("cell"), F.col("reach"), F.xxhash64("query_id")]
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("keys", T.ArrayType(dealt.schema["query_id"].dataType)),
        *[T.StructField(n, T.BinaryType()) for n in ("cells", "reaches", "vectors")]])
    names = schema.names

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, None

        def block(table):
            nonlocal number
            number += 1
            keys = table.column("query_id").combine_chunks()
            whole = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
            raw = [table.column("cell").to_numpy().astype("<i4"), table.column("reach").to_numpy().astype("<f8"), flat]
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([table.column("dim")[0].as_py()], pa.int32()), whole,
                *[pa.array([x.tobytes()], pa.binary()) for x in raw]], names)

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            dims = np.asarray(held.column("dim"))
            edges = np.append(np.flatnonzero(np.diff(dims, prepend=-1)), len(dims)).tolist()
            at = 0
            for a, b in zip(edges[:-1], edges[1:]):
                at, rows = a, max(1, min(1024, block_bytes // (8 * int(dims[a]))))
                while b - at >= rows or at < b < len(dims):
                    n = min(rows, b - at)
                    yield block(held.slice(at, n))
                    at += n
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield block(held)

    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema)


VISIT = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("chunk", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in ("places", "queries", "bounds")]])


def visits(blocks: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(block, chunk, places, queries, bounds): the chunks that queries of a block must be compared with.

    Without a column ``bounds`` in ``blocks`` a query visits its home: the chunk of its own cell with distances from
    the pivot most like its own, and the next ones until there are ``k`` vectors. With bounds, distances of the k-th
    neighbour found so far, it visits every other chunk whose vectors may be as near: a vector at distance s from a pivot is no nearer to a query
    at distance d from it than |d - s|.
    """
    shared = cells.chunks.sparkSession.sparkContext.broadcast((cells.listed(), cells.pivots))
    distances, _, _ = _geometry()
    bounded = "bounds" in blocks.columns
    names = VISIT.names

    def homes(cell, reach, table, far):
        """Chunks for one query, nearest first by what the triangle inequality says, until they hold k vectors."""
        chunk, cells_, low, high, n = table
        a, b = np.searchsorted(cells_, [cell, cell + 1])
        if n[a:b].sum() >= k:
            gap = np.maximum(low[a:b] - reach, reach - high[a:b])
            order = a + np.argsort(np.maximum(gap, 0), kind="stable")
        else:  # a small cell: all chunks in the order of their bounds
            d = far()[cells_]
            order = np.argsort(np.maximum(np.maximum(low - d, d - high), 0), kind="stable")
        return order[:int(np.searchsorted(np.cumsum(n[order]), k)) + 1]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tables, pivots = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                table = tables.get(row["dim"])
                if table is None:
                    continue
                chunk, cells_, low, high, n = table
                matrix = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                own, reach = np.frombuffer(row["cells"], "<i4"), np.frombuffer(row["reaches"], "<f8")
                centres = pivots.get(row["dim"])

                def away(part):
                    return distances(part, centres) if centres is not None else np.zeros((len(part), 1))

                home = [homes(c, r, table, lambda i=i: away(matrix[i:i + 1])[0]) for i, (c, r) in enumerate(zip(own, reach))]
                if not bounded:
                    bound = np.full(len(matrix), np.inf)
                    places = np.repeat(np.arange(len(matrix)), [len(h) for h in home])
                    which = np.concatenate(home)
                else:
                    bound, far = np.frombuffer(row["bounds"], "<f8"), away(matrix)
                    slack = 1e-9 * (far + np.where(np.isfinite(bound), bound, 0)[:, None])
                    found = []
                    for c in np.unique(cells_):
                        a, b = np.searchsorted(cells_, [c, c + 1])
                        d, most = far[:, c, None], (bound + slack[:, c])[:, None]
                        if centres is None:
                            near = np.ones((len(matrix), b - a), bool)
                        else:
                            near = (low[None, a:b] - d <= most) & (d - high[None, a:b] <= most)
                        p, w = np.nonzero(near)
                        found.append((p, w + a))
                    places, which = (np.concatenate(x) for x in zip(*found))
                    seen = np.repeat(np.arange(len(matrix)), [len(h) for h in home]) * len(chunk) + np.concatenate(home)
                    new = ~np.isin(places * len(chunk) + which, seen)
                    places, which = places[new], which[new]
                order = np.argsort(which, kind="stable")
                places, which = places[order], which[order]
                starts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
                for a, b in zip(starts, [*starts[1:], len(which)]):
                    p = places[a:b]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["block"]], pa.int64()), pa.array([int(chunk[which[a]])], pa.int64()),
                        *[pa.array([x.tobytes()], pa.binary()) for x in (p.astype("<i4"), matrix[p], bound[p])]], names)

    return blocks.mapInArrow(run, VISIT)


HIT = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("distance", T.DoubleType())])


def _compare(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The up to ``k`` nearest vectors of each visited chunk that are no farther than the query's bound."""
    start, merge, _, _ = _top_k(k)
    joined = asked.join(cells.chunks.select("chunk", "dim", "ids", "vectors"), "chunk")
    names = HIT.names

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = np.iinfo(np.int64).max
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                dim = column["dim"][i].as_py()
                queries = np.frombuffer(column["queries"][i].as_buffer(), "<f8").reshape(-1, dim)
                ids = column["ids"][i].values.to_numpy()
                raw = column["vectors"][i].as_buffer()
                vectors = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(ids) else "<f8").astype(np.float64).reshape(-1, dim)
                dist, who = start(len(queries))
                dist[:] = np.frombuffer(column["bounds"][i].as_buffer(), "<f8")[:, None]
                merge((dist, who), queries, ids, vectors)
                at, nth = np.nonzero(np.isfinite(dist) & (who != last))
                places = np.frombuffer(column["places"][i].as_buffer(), "<i4")[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), column["block"][i].as_py()), pa.int64()), pa.array(places, pa.int32()),
                    pa.array(who[at, nth], pa.int64()), pa.array(dist[at, nth], pa.float64())], names)

    return joined.mapInArrow(run, HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("block", "place").orderBy("distance", "doc_id")
    return hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _with_bounds(blocks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Blocks with the distance of the k-th hit of every query, infinity for a query with fewer."""
    kth = hits.filter(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("place", "distance")).alias("kth"))  # a block's queries
    joined = blocks.join(kth, "block", "left")
    schema = T.StructType([*blocks.schema.fields, T.StructField("bounds", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bounds = []
            for keys, kth in zip(batch.column("keys"), batch.column("kth").to_pylist()):
                bound = np.full(len(keys.values), np.inf)
                for hit in kth or ():
                    bound[hit["place"]] = hit["distance"]
                bounds.append(bound.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bounds, pa.binary())], schema.names)

    return joined.mapInArrow(run, schema)


PACK = T.StructType([
    T.StructField("pack", T.LongType()), T.StructField("dim", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ("cells", "lows", "highs", "sizes", "ids", "found")]])


def _pack_bytes(most: int, volume: int, spark: SparkSession) -> int:
    return max(LEAST_PACK, min(most, volume // (2 * spark.sparkContext.defaultParallelism)))


def _volume(cells: Cells) -> int:
    return sum(8 * dim * int(table[-1].sum()) for dim, table in cells.listed().items())


def _parts(asked: int, held: int, spark: SparkSession) -> dict[str, str]:
    """Settings by which a task reads parts of packs of the given volumes, four tasks for a core where there is enough."""
    part = int((asked * held / (4 * spark.sparkContext.defaultParallelism)) ** 0.5)
    part = max(LEAST_PART, min(MOST_PART, part))
    return {"spark.sql.files.maxPartitionBytes": str(part), "spark.sql.files.openCostInBytes": "65536", "spark.sql.files.minPartitionNum": "1"}


def _packs(cells: Cells) -> DataFrame:
    """(pack, dim, cells, lows, highs, sizes, ids, found): chunks of one length of vector side by side, stored once for all
    uses of ``cells`` until they are released."""
    if cells.packs is not None:
        return cells.packs
    names, pack_bytes = PACK.names, _pack_bytes(PACK_BYTES, _volume(cells), cells.chunks.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, volume, size = TaskContext.get().partitionId() << 32, [], 0, None

        def out():
            nonlocal number
            number += 1
            meta = [np.array(x, t).tobytes() for x, t in zip(zip(*(row[:4] for row in held)), ("<i4", "<f8", "<f8", "<i8"))]
            packed = [*meta, b"".join(row[4] for row in held), b"".join(row[5] for row in held)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], names)

        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                dim, raw = column["dim"][i].as_py(), column["vectors"][i].as_py()
                ids = column["ids"][i].values.to_numpy()
                if held and (dim != size or volume + 8 * dim * len(ids) > pack_bytes):
                    yield out()
                    held, volume = [], 0
                size, volume = dim, volume + 8 * dim * len(ids)
                held.append((*[column[n][i].as_py() for n in ("cell", "low", "high")], len(ids), ids.astype("<i8").tobytes(), raw))
        if held:
            yield out()

    chunks = cells.chunks.select("dim", "cell", "low", "high", "ids", "vectors")
    cells.packs = written(chunks.mapInArrow(run, PACK), "packs", 1, "none")
    return cells.packs


def _ruled_out():
    """Numpy helper as a closure, shipped by value: which queries may find a vector within their bound in a chunk."""
    import numpy as np

    def far(queries, centres):
        """(least, most) distances from the centres, from one product with its error bound."""
        q_norm, c_norm = (np.einsum("ij,ij->i", x, x)[:, None] for x in (queries, centres))
        both = q_norm + c_norm.T
        square, off = both - 2.0 * (queries @ centres.T), (queries.shape[1] + 16) * 2.0 ** -51 * both
        return np.sqrt(np.maximum(square - off, 0)), np.sqrt(np.maximum(square, 0) + off)

    def near(least, most, low, high, bound):
        bound = bound + 1e-9 * (most + np.where(np.isfinite(bound), bound, 0))
        return (low - most <= bound) & (least - high <= bound)

    return far, near


def _aimed(blocks: DataFrame, cells: Cells, pack_bytes: int = 0) -> DataFrame:
    """(queries, dim, blocks, counts, vectors, bounds, wanted): blocks side by side, up to so many bytes, and the packs of
    chunks that may hold a vector within the bound of one of their queries."""
    listed: dict = {}
    for row in _packs(cells).select("dim", "pack", "cells", "lows", "highs").toLocalIterator():  # their number is bounded, as in Cells.listed
        listed.setdefault(row["dim"], []).append((row["pack"], *[np.frombuffer(row[n], t) for n, t in (("cells", "<i4"), ("lows", "<f8"), ("highs", "<f8"))]))
    tables = {dim: (np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), *[np.concatenate([r[j] for r in rows]) for j in (1, 2, 3)])
              for dim, rows in listed.items()}
    shared = blocks.sparkSession.sparkContext.broadcast((tables, cells.pivots))
    far, near = _ruled_out()
    schema = T.StructType([
        T.StructField("queries", T.LongType()), T.StructField("dim", T.IntegerType()),
        *[T.StructField(n, T.BinaryType()) for n in ("blocks", "counts", "vectors", "bounds")], T.StructField("wanted", T.ArrayType(T.LongType()))])
    names = schema.names

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tables, pivots = shared.value
        number, held, volume, size = TaskContext.get().partitionId() << 32, [], 0, None

        def out():
            nonlocal number
            number += 1
            counts = np.array([len(row[2]) // 8 for row in held], "<i8")
            wanted = np.unique(np.concatenate([row[3] for row in held]))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([size], pa.int32()), pa.array([np.array([row[0] for row in held], "<i8").tobytes()], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()), *[pa.array([b"".join(row[j] for row in held)], pa.binary()) for j in (1, 2)],
                pa.array([wanted], pa.list_(pa.int64()))], names)

        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in tables:
                    continue
                pack, cells_, low, high = tables[dim]
                wanted = np.unique(pack)
                if dim in pivots:
                    least, most = far(np.frombuffer(row["vectors"], "<f8").reshape(-1, dim), pivots[dim])
                    bound, some = np.frombuffer(row["bounds"], "<f8")[:, None], np.zeros(len(pack), bool)
                    for a in range(0, len(pack), 1024):
                        c = cells_[a:a + 1024]
                        some[a:a + 1024] = near(least[:, c], most[:, c], low[None, a:a + 1024], high[None, a:a + 1024], bound).any(axis=0)
                    wanted = np.unique(pack[some])
                if held and (dim != size or volume + len(row["vectors"]) > pack_bytes):
                    yield out()
                    held, volume = [], 0
                size, volume = dim, volume + len(row["vectors"])
                held.append((row["block"], row["vectors"], row["bounds"], wanted))
        if held:
            yield out()

    return blocks.select("block", "dim", "vectors", "bounds").sortWithinPartitions("dim", "block").mapInArrow(run, schema)


#: Packs of queries whose best hits a task of the second job keeps: pairs come pack by pack.
KEPT_BLOCKS = 1


def _sweep(aimed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The up to ``k`` nearest vectors no farther than each query's bound, for every pack of queries and part of the chunks.

    Packs of queries and of chunks are two stored tables, and a task reads a part of each: nothing is shuffled but the hits.
    A task folds the chunks that a query meets into one running list, whose k-th distance tightens the bound as it goes.
    Where the bounds rule out little, a pack meets a pack in one product, else chunk by chunk with the queries left. The
    product of the two tables goes through all chunks of the task for one pack of queries after the other, so the queries
    themselves go to Python with the first of these chunks only.
    """
    start, merge, _, _ = _top_k(k)
    far, near = _ruled_out()
    shared = aimed.sparkSession.sparkContext.broadcast(cells.pivots)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the part that a task reads
    packs = _packs(cells).drop("dim").withColumn("first", place == 0)
    pairs = aimed.join(packs.hint("shuffle_replicate_nl"), F.col("first") | F.array_contains("wanted", F.col("pack")))
    asked = [F.when(F.col("first"), F.col(n)).alias(n) for n in ("blocks", "counts", "vectors", "bounds")]
    pairs = pairs.select("queries", "dim", *asked, F.array_contains("wanted", F.col("pack")).alias("meet"),
                         *[F.when(F.array_contains("wanted", F.col("pack")), F.col(n)).alias(n) for n in PACK.names[2:]])
    names, most = HIT.names, KEPT_BLOCKS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, pivots, held = np.iinfo(np.int64).max, shared.value, {}

        def out(number):
            _, dist, who, block, place = held.pop(number)
            at, nth = np.nonzero(np.isfinite(dist) & (who != last))
            return pa.RecordBatch.from_arrays([
                pa.array(block[at], pa.int64()), pa.array(place[at], pa.int32()),
                pa.array(who[at, nth], pa.int64()), pa.array(dist[at, nth], pa.float64())], names)

        def some(queries, dist, who, rows, ids, vectors):
            if len(rows) == len(queries):
                merge((dist, who), queries, ids, vectors)
            elif len(rows):
                best = dist[rows], who[rows]
                merge(best, queries[rows], ids, vectors)
                dist[rows], who[rows] = best

        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                number, dim = column["queries"][i].as_py(), column["dim"][i].as_py()
                if column["vectors"][i].is_valid:
                    while len(held) >= most:
                        yield out(next(iter(held)))
                    queries = np.frombuffer(column["vectors"][i].as_buffer(), "<f8").reshape(-1, dim)
                    counts = np.frombuffer(column["counts"][i].as_buffer(), "<i8")
                    dist, who = start(len(queries))
                    # a little more than the bound, so that the hit which made it comes again
                    dist[:] = np.frombuffer(column["bounds"][i].as_buffer(), "<f8")[:, None] * (1 + 1e-9) + 1e-300
                    place = np.arange(len(queries)) - np.repeat(np.cumsum(counts) - counts, counts)
                    held[number] = queries.copy(), dist, who, np.repeat(np.frombuffer(column["blocks"][i].as_buffer(), "<i8"), counts), place
                if not column["meet"][i].as_py():
                    continue
                part = {n: np.frombuffer(column[n][i].as_buffer(), t) for n, t in (
                    ("cells", "<i4"), ("lows", "<f8"), ("highs", "<f8"), ("sizes", "<i8"), ("ids", "<i8"))}
                queries, dist, who, _, _ = held[number]
                raw = column["found"][i].as_buffer()
                vectors = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(part["ids"]) else "<f8").reshape(-1, dim)
                if dim not in pivots:
                    some(queries, dist, who, np.arange(len(queries)), part["ids"], vectors.astype(np.float64, copy=False))
                    continue
                known, own = np.unique(part["cells"], return_inverse=True)
                low, high = far(queries, pivots[dim][known])
                meets = near(low[:, own], high[:, own], part["lows"], part["highs"], dist[:, -1:])
                active = np.flatnonzero(meets.any(axis=1))
                if 2 * (meets.sum(axis=0) * part["sizes"]).sum() >= len(active) * len(vectors):
                    some(queries, dist, who, active, part["ids"], vectors.astype(np.float64, copy=False))
                    continue
                ends = np.cumsum(part["sizes"])
                for j in np.flatnonzero(meets.any(axis=0)):
                    s, c = slice(ends[j] - part["sizes"][j], ends[j]), own[j]
                    rows = np.flatnonzero(meets[:, j] & near(low[:, c], high[:, c], part["lows"][j], part["highs"][j], dist[:, -1]))
                    some(queries, dist, who, rows, part["ids"][s], vectors[s].astype(np.float64, copy=False))
        while held:
            yield out(next(iter(held)))

    return pairs.mapInArrow(run, HIT)


def nearest(index: DataFrame, queries: DataFrame, k: int = 2, block_bytes: int = BLOCK_BYTES, cells: Cells | None = None) -> DataFrame:
    """The ``k`` nearest index rows per query: (query_id, doc_id, distance, rank), stored in the shared folder.

    ``index`` needs (doc_id long, embedding), ``queries`` (query_id of any type, unique, embedding); ties go to the
    smaller doc_id. A query is compared with the vectors of its own length; rows without a vector of finite
    numbers are left out on both sides (``left_out`` counts them), and so are queries without any hit.

    The index is dealt to cells around pivots (``cells``: those of a stored index, else made here and deleted afterwards), in
    chunks of known distances from the pivot. Queries are packed in blocks of neighbours. In a first job every query
    travels to its home chunk, which bounds the distance of its k-th neighbour. In a second one every query meets all
    chunks that the triangle inequality does not rule out: blocks and chunks are stored side by side in larger packs, and
    each task reads a part of the ones and of the others, so that queries and vectors are not shuffled again, however many
    chunks a query must see, and much is computed for what is read.
    """
    made = cells is None
    with small_buffers(queries.sparkSession):
        cells = build_cells(index) if made else cells
        blocks = written(_blocks(queries.select("query_id", "embedding"), cells.pivots, block_bytes), "query-blocks", compression="none")
        home = written(_best(_compare(visits(blocks, cells, k), cells, k), k), "home-hits")
        volume = blocks.agg(F.sum(F.size("keys").cast("long") * F.col("dim") * 8)).first()[0] or 0
        pack_bytes = _pack_bytes(ASKED_BYTES, volume, queries.sparkSession)
        aimed = written(_aimed(_with_bounds(blocks, home, k), cells, pack_bytes), "aimed-blocks", 1, "none")
        hits = _best(_sweep(aimed, cells, k), k)
        keys = blocks.select("block", F.posexplode("keys").alias("place", "query_id"))
        with settings(queries.sparkSession, _parts(volume, _volume(cells), queries.sparkSession)):
            result = written(hits.join(keys, ["block", "place"]).select("query_id", "doc_id", "distance", "rank"), "hits")
    for table in (blocks, home, aimed, _packs(cells)):
        release(table)
    cells.packs = None
    if made:
        cells.release()
    return result
