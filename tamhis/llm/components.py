"""Connected components of a graph given as a table of edges, by alternating star operations."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.workspace import written

#: Edges that one local contraction holds at a time.
CHUNK_EDGES = 1 << 20


def _forest(a, b):
    """Star edges (node, smallest node of its part) of the graph with edges a[i]-b[i]."""
    parent = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            low, high = (x, y) if x < y else (y, x)
            parent[high] = low
    return [(x, root(x)) for x in parent]


def _contract(batches):
    """Replace the edges of a task, a bounded chunk at a time, by a spanning forest of stars."""
    def star(a, b):
        edges = _forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    a, b = [], []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= CHUNK_EDGES:
            yield star(a, b)
            a, b = [], []
    if a:
        yield star(a, b)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Edges may repeat, point either way or be loops; rows with a null end are ignored. An empty table gives no
    rows. Each round attaches every node's larger neighbours to its smallest neighbour (large star), then
    its smaller ones (small star); minima are combined before the shuffle and joins are plain equi-joins, so
    a hub is no single task's work. Rounds are written to the shared folder: a lost executor costs a re-read.
    Nothing but two numbers a round goes to the driver.
    """
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    now = written(start.distinct().mapInArrow(_contract, "a long, b long").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame):
    return tuple(edges.select(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """edges have a > b"""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have a > b"""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
