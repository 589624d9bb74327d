import numpy as np
import pyarrow as pa
import pytest

from tamhis.llm import embedding_dedup as E
from tamhis.llm.hnsw import Hnsw

rng = np.random.default_rng(2)


def test_graph_finds_the_nearest():
    x = rng.standard_normal((1500, 24))
    x[200:400] = x[200] + 0.05 * rng.standard_normal((200, 24))  # a dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw(x, Hnsw.draw_levels(rng.integers(0, 1 << 62, len(x))))
    exact = np.argsort(-(x @ x.T), axis=1)[:, :8]
    ids, _ = graph.search(x, 64)
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, exact)]) > 0.9
    wide, _ = graph.search(x[:50], len(x))
    assert all(len(set(r)) == len(x) for r in wide)  # every node can be reached


def brute(rows, threshold):
    part = {k: k for k, _, _ in rows if k is not None}
    degree = {}
    unit = {}
    for i, (k, v, label) in enumerate(rows):
        if k is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        unit[i] = np.array(v, np.float32).astype(float)
        unit[i] = unit[i] / np.linalg.norm(unit[i])
    pairs = [(i, j) for i in unit for j in unit if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold]
    for i, _ in pairs:
        degree[i] = degree.get(i, 0) + 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            a, b = rows[i][0], rows[j][0]
            if part[a] < part[b]:
                part[b], changed = part[a], True
    return sorted(((k, degree.get(i, 0), part.get(k), part.get(k) == k) for i, (k, _, _) in enumerate(rows) if k is not None))


@pytest.mark.parametrize("shard_rows, beam", [(4096, 32), (40, 2)])
def test_links_and_components(spark, monkeypatch, shard_rows, beam):
    monkeypatch.setattr(E, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(E, "BEAM", beam)
    x = rng.standard_normal((300, 8))
    for i in range(100, 200):
        x[i] = x[i % 10] + rng.standard_normal(8) * 0.06
    rows = [(1000 - i, [float(np.float32(a)) for a in v], "ab"[i % 3 == 0] if i % 17 else None) for i, v in enumerate(x)]
    copies = [(2000 + i, rows[4][1], rows[4][2]) for i in range(60)]
    scaled = [(3000, [2 * a for a in rows[4][1]], rows[4][2])]
    odd = [(4000, None, "a"), (4001, [], "a"), (4002, [0.0] * 8, "a"), (4003, [float("nan")] + [1.0] * 7, "a"), (4004, [None] + [1.0] * 7, "a"),
           (4005, [float("inf")] + [1.0] * 7, "a"), (4006, rows[4][1][:5], rows[4][2])]
    rows += copies + scaled + odd
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").selectExpr("*", "1 AS size", "2 AS grp").repartition(4)
    got = sorted(map(tuple, E.near_duplicate_vectors(table).collect()))
    assert got == brute(rows, 0.98)
    assert sum(r[1] for r in got) > 61 * 60


def test_null_and_repeated_keys(spark):
    rows = [(None, [1.0, 0.0], "a"), (5, [1.0, 0.0], "a"), (5, [0.0, 1.0], "a"), (3, [0.0, 1.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicate_vectors(table).collect()), key=str)
    assert got[-1] == (None, 0, None) and {c for k, _, c in got if k} <= {3, 5}
    assert E.near_duplicate_vectors(table.limit(0)).count() == 0


def test_rare_links_are_found_where_the_graph_does_not_lead(monkeypatch):
    monkeypatch.setattr(E, "BEAM", 256)  # wide enough for the nearest of random vectors
    own = np.random.default_rng(3)
    x = own.standard_normal((2000, 16))
    asked = own.standard_normal((2000, 16))
    lost = [300, 900, 1500]
    asked[[10, 20, 30]] = x[lost] + 0.01 * own.standard_normal((3, 16))

    def table(first, vectors):
        n = len(vectors)
        return pa.table({"grp": ["g"] * n, "shard": [0] * n, "shards": [2] * n, "rep": np.arange(first, first + n), "size": [1] * n,
                         "vector": [v.tolist() for v in vectors], "draw": own.integers(0, 1 << 62, n)})

    index = E._build(table(0, x))
    links = [[[-1 if k in lost else k for k in level] for level in node] for node in index.column("links").to_pylist()]
    index = index.set_column(index.column_names.index("links"), "links", pa.array(links, pa.list_(pa.list_(pa.int32()))))
    found = E._search(0.98)(index, table(7000, asked)).to_pydict()
    assert set(found["rep"]) >= {*lost, 7010, 7020, 7030} and found["n"] == [1] * len(found["n"])


def test_link_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD_ROWS", 700)
    own = np.random.default_rng(4)
    x = own.standard_normal((4000, 16))
    for i in range(1000, 2600):  # groups of three
        x[i] = x[i % 800] + own.standard_normal(16) * 0.04
    x = x.astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = dict((r.vec_id, r.n_links) for r in E.near_duplicate_vectors(table).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 2000 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= w for i, w in enumerate(want))
    print("link recall", sum(got.values()), "of", want.sum())


def _shard(first, vectors, shards=1, seed=9):
    n = len(vectors)
    return pa.table({"grp": ["g"] * n, "shard": [0] * n, "shards": [shards] * n, "rep": np.arange(first, first + n), "size": [1] * n,
                     "vector": [v.tolist() for v in vectors], "draw": np.random.default_rng(seed).integers(0, 1 << 62, n)})


@pytest.mark.parametrize("kind", ["218 without links", "5000 without links", "5000 with rare links", "5000 with many links", "two shards, rare links"])
def test_the_graph_answers_the_queries(monkeypatch, kind):
    """Counts the queries that are compared by products with the whole shard, and the links that are found."""
    own = np.random.default_rng(11)
    n = int(kind.split()[0]) if kind[0] != "t" else 3000
    x = own.standard_normal((n, 64))
    if "rare" in kind:  # one in two hundred
        x[: n // 200] = x[n // 2: n // 2 + n // 200] + own.standard_normal((n // 200, 64)) * 0.15
    if "many" in kind:
        for i in range(n // 2):
            x[i] = x[n // 2 + i % 700] + own.standard_normal(64) * 0.1
    asked, first = x, 0
    if kind[0] == "t":
        asked, first = own.standard_normal((n, 64)), 10_000
        asked[:30] = x[500:530] + own.standard_normal((30, 64)) * 0.15
    products = []
    plain = E._all
    monkeypatch.setattr(E, "_all", lambda units, queries, floor: (products.append(len(queries) * len(units)), plain(units, queries, floor))[1])
    index = E._build(_shard(0, x))
    found = E._search(0.98)(index, index if not first else _shard(first, asked)).to_pydict()
    assert sum(products) < 0.1 * n * len(asked)  # the graph has answered over nine tenths
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, asked)]
    want = (unit[1] @ unit[0].T >= 0.98).sum() - (0 if first else n)
    got = sum(found["n"]) // (2 if first else 1)
    assert got <= want and got >= 0.95 * want and (want > 20 or "without" in kind)
    print(kind, "links", got, "of", want)
