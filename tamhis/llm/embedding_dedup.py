"""Near-duplicate vectors: small-world graphs per shard, every shard searched, cosines verified, components united."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.llm.common import col, join_classes
from tamhis.llm.components import connected_components
from tamhis.llm.hnsw import Hnsw
from tamhis.workspace import written

THRESHOLD = 0.98
#: Vectors of a shard: what one task holds, twice.
SHARD_ROWS = 16_384
#: First beam of a search; it is doubled until the audit of a task passes.
BEAM = 32
#: A beam is audited on so many queries, or this part of them, by products with the whole shard, and on so many planted
#: vectors: copies of nodes turned until their cosine is this part of the way from the threshold to one. It passes if it finds
#: all links of the former and this share of the latter.
AUDIT, AUDIT_PART, PLANTED, PLANTED_AT, AUDIT_RECALL = 64, 1 / 128, 128, 0.1, 0.98
#: A beam that would be wider than this part of a shard, or this many times the first, is replaced by products with the shard.
WIDEST, WIDENINGS = 1 / 16, 8


def usable(v: Column) -> Column:
    """True for a vector with a direction: only finite components, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column) -> np.ndarray:
    """Unit vectors in double precision of a list column whose lists are of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


_GRAPH = "grp string, shard long, shards long, rep long, size long, vector array<double>, level long, links array<array<int>>"


def _build(table: pa.Table) -> pa.Table:
    """The graph of one shard; nodes are numbered by ``rep``."""
    table = table.sort_by("rep")
    levels = Hnsw.draw_levels(table.column("draw").to_numpy())
    graph = Hnsw(_units(table.column("vector")), levels)
    links = [[layer[i].tolist() for layer in graph.layers[: levels[i] + 1]] for i in range(len(levels))]
    table = table.drop_columns(["draw"])
    return table.append_column("level", pa.array(levels)).append_column("links", pa.array(links, pa.list_(pa.list_(pa.int32()))))


def _load(table: pa.Table) -> tuple[pa.Table, np.ndarray, Hnsw]:
    table = table.sort_by("rep")
    units, levels = _units(table.column("vector")), table.column("level").to_numpy()
    links = table.column("links").to_pylist()
    layers = []
    for level in range(int(levels.max()) + 1):
        width = max(len(x[level]) for x in links if len(x) > level)
        layer = np.full((len(links), width), -1, np.int32)
        for i, x in enumerate(links):
            if len(x) > level:
                layer[i] = x[level]
        layers.append(layer)
    return table, units, Hnsw(units, levels, layers)


def _hits(graph: Hnsw, queries: np.ndarray, own, beam: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs above ``floor``; a query whose whole beam is above it is asked again with a wider one, until
    that would be a large part of the shard: then the products are taken, which is exact and cheaper."""
    rows, found = [], []
    left, n = np.arange(len(queries)), len(graph.vectors)
    while len(left):
        ids, sims = graph.search(queries[left], min(beam, n), None if own is None else own[left])
        good = (ids >= 0) & (sims >= floor)
        full = good.all(axis=1) & (beam < n)
        r, c = np.nonzero(good & ~full[:, None])
        rows.append(left[r])
        found.append(ids[r, c])
        left = left[full]
        beam *= 2
        if len(left) and beam > n * WIDEST:
            q, node = _all(graph.vectors, queries[left], floor)
            rows.append(left[q])
            found.append(node)
            break
    return np.concatenate(rows), np.concatenate(found)


def _search(threshold: float):
    floor = threshold - 1e-4  # the graph holds single precision

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(index) or not len(asked):
            return pa.table([pa.array([], pa.int64())] * 3, _LINKS)
        index, units, graph = _load(index)
        asked = asked.sort_by("rep")
        queries = _units(asked.column("vector"))
        reps, own_reps = index.column("rep").to_numpy(), asked.column("rep").to_numpy()
        own = np.arange(len(reps)) if len(reps) == len(own_reps) and (reps == own_reps).all() else None
        order = np.argsort((own_reps * np.int64(-7046029254386353131)) ^ np.int64(0x5851F42D), kind="stable")
        sample = order[:max(AUDIT, int(len(order) * AUDIT_PART))]
        exact = queries[sample] @ units.T
        planted, targets = _planted(units, threshold + (1 - threshold) * PLANTED_AT)
        beam, widest = BEAM, max(BEAM * WIDENINGS, len(reps) * WIDEST)
        while beam <= widest and not _audit(exact, graph, queries[sample], None if own is None else own[sample], planted, targets, beam, floor):
            beam *= 2
        found = [_hits(graph, queries, own, beam, floor) if beam <= widest else _all(units, queries, floor)]
        q, node = np.nonzero(exact >= floor)
        found.append((sample[q], node))
        stray = graph.stray()  # no search can lead to these
        q, node = _all(units[stray], queries, floor)
        found.append((q, stray[node]))
        q, node = (np.concatenate(x) for x in zip(*found))
        pair = np.unique(q * len(reps) + node)
        q, node = pair // len(reps), pair % len(reps)
        cosine = np.concatenate([np.einsum("id,id->i", queries[q[k:k + 65536]], units[node[k:k + 65536]])
                                 for k in range(0, len(q), 65536)]) if len(q) else np.empty(0)
        keep = (cosine >= threshold) & (own_reps[q] != reps[node])
        sizes = np.concatenate([asked.column("size").to_numpy(), index.column("size").to_numpy()])
        return _links(np.concatenate([own_reps, reps]), sizes, q[keep], node[keep] + len(own_reps), own is not None)

    return search


def _links(reps: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> pa.Table:
    """(rep, n, root) of every linked node: vectors linked to it here, and the smallest rep of its part.

    One row per node, not one per link, so a dense group costs no more than its size. ``same``: both sides are one shard,
    so that a link may have been found from either end.
    """
    if same:
        b = b - len(reps) // 2
        n = len(reps) // 2
        low, high = np.minimum(a, b), np.maximum(a, b)
        code = np.unique(low * n + high)
        a, b = code // n, code % n
    count = np.bincount(a, sizes[b], len(reps)) + np.bincount(b, sizes[a], len(reps))
    root = np.argsort(np.argsort(reps, kind="stable"), kind="stable")  # rank by rep, so that the smallest rep wins
    order = np.argsort(reps, kind="stable")
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[order[low]])
        if (low == root).all():
            break
        root = low
    at = np.nonzero(count)[0]
    return pa.table([pa.array(reps[at]), pa.array(count[at].astype(np.int64)), pa.array(reps[order[root[at]]])], _LINKS)


_LINKS = ["rep", "n", "root"]


def _planted(units: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at the given cosine from some nodes, in directions that depend on the shard's size alone, and these nodes."""
    draw = np.random.default_rng(len(units))
    targets = draw.choice(len(units), min(PLANTED, len(units)), replace=False)
    side = draw.standard_normal((len(targets), units.shape[1]))
    side -= np.einsum("id,id->i", side, units[targets])[:, None] * units[targets]
    length = np.sqrt((side * side).sum(axis=1, keepdims=True))
    side = np.where(length > 1e-9, side / np.maximum(length, 1e-9), 0)  # no other direction in one dimension
    out = cosine * units[targets] + np.sqrt(1 - cosine * cosine) * side
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True)), targets


def _audit(exact, graph, queries, own, planted, targets, beam, floor) -> bool:
    """Whether a beam finds all links of the sampled queries and most planted ones."""
    got = np.zeros(exact.shape, bool)
    got[_hits(graph, queries, own, beam, floor)] = True
    if (~got & (exact >= floor + 1e-4)).any():
        return False
    q, node = _hits(graph, planted, None, beam, floor)
    return len(np.unique(q[node == targets[q]])) >= AUDIT_RECALL * len(targets)


def _all(units, queries, threshold):
    parts = [np.nonzero(queries[k:k + 512] @ units.T >= threshold) for k in range(0, len(queries), 512)]
    return np.concatenate([p[0] + 512 * k for k, p in enumerate(parts)]), np.concatenate([p[1] for p in parts])


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                           threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``; ``key`` must be an integer.

    Two vectors are linked if their labels are equal and not null, they have equally many components and their
    cosine (double precision) is at least ``threshold``. n_links counts the other vectors linked directly,
    component_id is the smallest key reachable by links, kept is true for that vector. Null, empty and zero vectors,
    vectors with null or non-finite components, null labels and null keys link with nothing. Copies of a vector
    are one node with a size; rows that repeat a key are vectors of their own that share its component.

    Each label's vectors are cut into shards of about ``SHARD_ROWS``, so a label may hold any share of the rows. A task
    builds one shard's graph; every shard is then asked for every block of its label's vectors. The graph answers all
    queries, with beams that widen until an audit passes: all links of a sample of queries, told by products with
    the whole shard, and nearly all of the copies planted just above the threshold must be found, so the audit has something
    to find where links are rare. A graph that does not pass with its widest beam is replaced by blocked products. Nodes that
    no link leads to are compared with all queries. A link of the sample is kept whoever found it.
    """
    v = col(embedding).cast("array<double>")
    rows = vectors.select(col(key).cast("long").alias("key"), v.alias("vector"), col(label).cast("string").alias("label"))
    rows = rows.withColumn("linkable", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("key").isNotNull())
    # the class of exact copies by 128 bits of hash
    rows = rows.withColumns({
        "grp": F.when(F.col("linkable"), F.concat_ws("|", F.size("vector").cast("string"), "label")),
        "h1": F.when(F.col("linkable"), F.xxhash64("vector", "label")),
        "h2": F.when(F.col("linkable"), F.xxhash64(F.lit(1), "label", "vector")),
    })
    own = rows.filter("linkable")
    classes = written(own.groupBy("grp", "h1", "h2").agg(
        F.min("key").alias("rep"), F.count("*").alias("size"), F.any_value("vector").alias("vector")), "vector-classes")
    shards = classes.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).alias("shards"))
    dealt = classes.join(shards, "grp").select(
        "grp", F.pmod(F.xxhash64("rep"), F.col("shards")).alias("shard"), "shards", "rep", "size", "vector",
        F.xxhash64("rep", F.lit(2)).alias("draw"))
    graphs = written(dealt.groupBy("grp", "shard").applyInArrow(_build, _GRAPH), "graphs")
    shard, last = F.col("shard"), F.col("shards") - 1
    index = graphs.select("grp", shard.alias("i"), F.explode(F.sequence(shard, last)).alias("j"), "rep", "size", "vector", "level", "links")
    asked = graphs.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), shard)).alias("i"), shard.alias("j"), "rep", "size", "vector")
    linked = written(index.groupBy("grp", "i", "j").cogroup(asked.groupBy("grp", "i", "j")).applyInArrow(
        _search(threshold), "rep long, n long, root long"), "vector-links")
    links = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    found = written(classes.drop("vector").join(links, "rep", "left").join(parts, "rep", "left").select(
        "grp", "h1", "h2", "size", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component")), "vector-components")
    joined = join_classes(own.select("key", "grp", "h1", "h2"), found, ["grp", "h1", "h2"], "size").select("key", "n_links", "component")
    alone = rows.filter("not linkable").select("key", F.lit(0).cast("long"), F.col("key"))
    component = F.col("component")
    return joined.union(alone).select(F.col("key").alias(key), "n_links", component.alias("component_id"),
                                      F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))
