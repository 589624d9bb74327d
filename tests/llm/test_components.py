import random

import pytest

from tamhis.llm import components
from tamhis.llm.components import connected_components


def parts_of(edges):
    part = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    return part


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_components_equal_plain_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK_EDGES", chunk)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(9, 9)]
    table = spark.createDataFrame([*edges, *edges[:20], (None, 3)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in connected_components(table).collect()}
    want = {x: p for x, p in parts_of([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert connected_components(table.limit(0)).count() == 0
