import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis.operators import cells as C
from tamhis.operators import nearest as N
from tamhis.schemas import INDEX
from tamhis.sources import readers, writers


def frame(spark, name, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, embedding array<float>")


def brute(queries, docs, k):
    d = np.sqrt(((queries[:, None, :].astype(float) - docs[None].astype(float)) ** 2).sum(axis=2))
    return {(q, r + 1): (int(i), round(float(d[q, i]), 9)) for q in range(len(queries)) for r, i in enumerate(np.lexsort((np.arange(len(docs)), d[q]))[:k])}


def found(df):
    return {(r.query_id, r.rank): (r.doc_id, round(r.distance, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 10
    docs = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 0.3).astype(np.float32)
    docs[1000:3000] = docs[1000]  # a third of all rows are copies
    queries = np.vstack([docs[::60], (centres[:20] + rng.normal(size=(20, 8))).astype(np.float32), rng.normal(size=(5, 8)).astype(np.float32) * 20])
    return docs, queries.astype(np.float32)


@pytest.mark.parametrize("k", [1, 3])
def test_most_chunks_are_left_out_and_no_neighbour_is_lost(spark, clustered, k):
    docs, queries = clustered
    index, asked = frame(spark, "doc_id", docs).repartition(4), frame(spark, "query_id", queries)
    cells = C.build_cells(index, chunk_rows=64)
    chunks = cells.chunks.collect()
    assert sum(c.n for c in chunks) == len(docs) and max(c.n for c in chunks) <= 64 and len(cells.pivots[8]) > 40
    for c in chunks[::20]:  # the stored distances hold for what a chunk contains
        pivot = cells.pivots[8][c.cell]
        far = np.sqrt(((np.frombuffer(c.vectors, "<f4").reshape(-1, 8).astype(float) - pivot) ** 2).sum(axis=1))
        assert far.min() == pytest.approx(c.low) and far.max() == pytest.approx(c.high)
    assert found(N.nearest(index, asked, k, cells=cells)) == brute(queries, docs, k)
    blocks = N.written(N._blocks(asked, cells.pivots, 1 << 20), "b")
    home = N.visits(blocks, cells, k)
    hits = N.written(N._best(N._compare(home, cells, k), k), "h")
    away = N.visits(N._with_bounds(blocks, hits, k), cells, k)
    looked = [sum(len(r.places) // 4 for r in part.collect()) for part in (home, away)]
    assert len(queries) <= looked[0] <= 2 * len(queries)
    pairs = len(queries) * len(chunks)
    print("chunks looked at", looked, "of", pairs)
    assert sum(looked) < 0.15 * pairs
    cells.release()


def test_stored_index(spark, tmp_path, clustered):
    docs, queries = clustered
    path = str(tmp_path / "index")
    writers.write_index(frame(spark, "doc_id", docs).withColumn("doc_text", F.lit("t")), path)
    index, cells = readers.read_index(spark, path), readers.read_cells(spark, path)
    assert index.schema == INDEX and index.count() == len(docs)
    assert found(N.nearest(index, frame(spark, "query_id", queries), 2, cells=cells)) == brute(queries, docs, 2)
    assert readers.read_cells(spark, path).chunks.count() > 0  # a stored index survives a search


def test_random_directions_of_several_lengths(spark):
    """Nothing can be left out in many dimensions; the result is the same."""
    rng = np.random.default_rng(6)
    docs, queries = rng.normal(size=(700, 48)).astype(np.float32), rng.normal(size=(30, 48)).astype(np.float32)
    index = frame(spark, "doc_id", docs)
    for dim in range(2, 13):  # more lengths than get pivots
        index = index.union(frame(spark, "doc_id", rng.normal(size=(5, dim)), 1000 * dim))
    asked = frame(spark, "query_id", queries).union(spark.createDataFrame([(100 + d, [0.0] * d) for d in range(2, 14)], "query_id long, embedding array<float>"))
    got = found(N.nearest(index, asked, 4, block_bytes=3000))
    want = brute(queries, docs, 4)
    assert {x: got[x] for x in want} == want
    assert {q - 100 for q, _ in got if q >= 100} == set(range(2, 13))
    assert all(got[100 + d, r][0] // 1000 == d for d in range(2, 13) for r in (1, 2, 3, 4))


def test_far_away_and_equal_vectors(spark):
    docs = np.array([[1e6, 0], [1e6, 1e-3], [-1e6, 0], [0, 0], [0, 0], [0, 0]], np.float32)
    queries = np.array([[1e6, 0], [0, 0], [-1e6, 1]], np.float32)
    got = N.nearest(frame(spark, "doc_id", docs), frame(spark, "query_id", queries), 3)
    assert found(got) == brute(queries, docs, 3)


def test_pivots_are_chosen_from_a_sample_of_bounded_bytes(spark, monkeypatch):
    seen, centres = [], C._centres
    monkeypatch.setattr(C, "_centres", lambda points, k: seen.append(points.nbytes) or centres(points, k))
    monkeypatch.setattr(C, "SAMPLE_BYTES", 1 << 16)
    docs = np.random.default_rng(7).normal(size=(900, 64)).astype(np.float32)
    index = frame(spark, "doc_id", docs).union(frame(spark, "doc_id", docs[:300, :32], 2000))
    pivots, total = C._choose_pivots(index)
    assert total == 1200 and set(pivots) == {32, 64} and len(seen) == 2
    assert sum(seen) <= (1 << 16) + 8 * (32 + 64)


@pytest.mark.parametrize("kept", [1, 256])
def test_vectors_are_not_shuffled_to_all_chunks(spark, monkeypatch, kept):
    """Blocks and chunks meet where they are stored; only hits are shuffled."""
    rng = np.random.default_rng(8)
    docs, queries = rng.normal(size=(900, 48)).astype(np.float32), rng.normal(size=(40, 48)).astype(np.float32)
    docs[100:200] = queries[0]  # copies: ties by id
    index, asked = frame(spark, "doc_id", docs), frame(spark, "query_id", queries)
    monkeypatch.setattr(N, "KEPT_BLOCKS", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells = C.build_cells(index, chunk_rows=32)
        assert found(N.nearest(index, asked, 3, block_bytes=4000, cells=cells)) == brute(queries, docs, 3)
        blocks = N._blocks(asked, cells.pivots, 4000)
        infinite = blocks.withColumn("bounds", F.expr(f"unhex(repeat('{np.array([np.inf], '<f8').tobytes().hex()}', size(keys)))"))
        aimed = N.written(N._aimed(infinite, cells), "aimed", rows_per_file=2)
        swept = N._sweep(aimed, cells, 3)
        plan = swept._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert len(aimed.inputFiles()) > 1 and swept.count() >= 3 * len(queries)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distances_are_computed_in_bounded_slices(monkeypatch):
    rng = np.random.default_rng(9)
    docs, queries = rng.normal(size=(500, 16)), rng.normal(size=(70, 16))
    monkeypatch.setattr(N, "GAP_BYTES", 1000)
    start, merge, _, _ = N._top_k(3)
    dist, who = start(len(queries))
    merge((dist, who), queries, np.arange(500), docs)
    assert {(q, r + 1): (int(who[q, r]), round(float(dist[q, r]), 9)) for q in range(70) for r in range(3)} == brute(queries, docs, 3)


def test_many_blocks_and_chunks_meet_in_few_pairs(spark, monkeypatch):
    """What a pair reads is large against the pair; queries go to Python once for each part of the chunks."""
    rng = np.random.default_rng(10)
    docs, queries = rng.normal(size=(900, 48)).astype(np.float32), rng.normal(size=(200, 48)).astype(np.float32)
    rows, store = {}, N.written

    def counted(df, name, *more, **other):
        rows[name] = (out := store(df, name, *more, **other)).count()
        return out

    cells = C.build_cells(frame(spark, "doc_id", docs), chunk_rows=16)
    monkeypatch.setattr(N, "written", counted)
    asked = frame(spark, "query_id", queries)
    assert found(N.nearest(asked, asked, 3, block_bytes=2000, cells=cells)) == brute(queries, docs, 3)
    assert cells.packs is None and cells.chunks.count() > 56 and rows["query-blocks"] > 20
    assert rows["aimed-blocks"] * rows["packs"] <= 64


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e5, 1e20, 1e100])
@pytest.mark.parametrize("away", [0.0, 1.0, 1e4])
def test_single_precision_loses_no_neighbour(scale, away):
    rng = np.random.default_rng(11)
    docs, queries = rng.normal(size=(3000, 32)) + away, rng.normal(size=(50, 32)) + away
    docs[500:900] = queries[7] + 1e-9 * rng.normal(size=(400, 32))  # nearer to each other than single precision tells
    docs[1000:2500:3] = docs[999]  # copies
    docs, queries = docs * scale, queries * scale
    start, merge, _, _ = N._top_k(4)
    best = start(len(queries))
    for a in (0, 1500):
        merge(best, queries, np.arange(a, a + 1500), docs[a:a + 1500])
    gaps = np.sqrt(((queries[:, None, :] - docs[None]) ** 2).sum(axis=2))
    order = np.argsort(gaps, axis=1, kind="stable")[:, :4]
    assert np.allclose(best[0], np.take_along_axis(gaps, order, 1), rtol=1e-9, atol=0) and (best[1] == order).all()
