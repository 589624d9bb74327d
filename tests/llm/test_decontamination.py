import random
from itertools import combinations

import numpy as np
import pytest

from tamhis.llm import decontamination as D

rng = random.Random(5)
VOCABULARY = [f"word{i}" for i in range(60)]


def line(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_any_two_substitutions_leave_a_mask_whole():
    assert len(D.MASKS) == 6 and {len(m) for m in D.MASKS} == {6}
    for pair in combinations(range(len(D.GROUPS)), 2):
        assert any(not set(pair) & set(m) for m in D.MASKS)


def brute(doc, items):
    """Items with a long enough stretch on some diagonal of which 80 % match."""
    found = set()
    for item, words in items:
        for shift in range(-len(words) + 1, len(doc)):
            first, last = max(0, -shift), min(len(words), len(doc) - shift)
            matches = [doc[shift + k] == words[k] for k in range(first, last)]
            need = min(D.MIN_WORDS, len(words))
            total = np.concatenate([[0], np.cumsum(matches)])
            if any(total[j] - total[i] >= D.SHARE * (j - i) - 1e-9 and total[j] - total[i] > 0
                   for i in range(len(matches)) for j in range(i + need, len(matches) + 1)):
                found.add(item)
    return found


def test_against_all_diagonals(spark):
    items = [(i, line(n)) for i, n in enumerate([14, 20, 35, 60, 13, 9, 6, 3])]
    docs = []
    for k in range(60):
        item, words = rng.choice(items)
        piece = list(words)
        for _ in range(rng.randint(0, 4)):
            piece[rng.randrange(len(piece))] = rng.choice(VOCABULARY)
        docs.append((k, line(rng.randint(0, 40)) + (piece if k % 3 else []) + line(rng.randint(0, 40))))
    text = [(k, " ".join(w.upper() + "," if rng.random() < 0.3 else w for w in d)) for k, d in docs]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    table = spark.createDataFrame(text, "doc_id long, text string")
    got = {}
    for r in D.overlaps(table, bench).collect():
        assert r.n_matching >= D.SHARE * r.n_words - 1e-6
        got.setdefault(r.doc_id, set()).add(r.item_id)
    want = {k: f for k, d in docs if (f := brute(d, [x for x in items if len(x[1]) >= D.SHORTEST]))}
    assert all(got.get(k, set()) <= want.get(k, set()) for k, _ in docs)
    planted = [(k, i) for k, s in want.items() for i in s]
    assert sum(i in got.get(k, ()) for k, i in planted) >= 0.97 * len(planted) > 20
    kept = {r.doc_id for r in D.clean(table, bench).collect()}
    assert kept == {k for k, _ in docs} - set(got)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 300])
def test_blocks_and_edges(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    items = [" ".join(line(30)) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None), (51, ""), (2, items[2])], "item_id long, text string")
    rows = [(i, f"lead {t} tail") for i, t in enumerate(items)] + [(3, f"lead {items[3]} tail"), (60, None), (61, ""), (None, items[0]),
                                                                   (62, "clean " * 30_000 + items[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n_overlaps")
    found = sorted(((r.doc_id, r.item_id, r.n_words) for r in D.overlaps(docs, bench).collect()), key=str)
    want = [(i, i, 30) for i in range(12)] + [(3, 3, 30), (2, 2, 30), (None, 0, 30), (62, 5, 30)]
    assert found == sorted(want, key=str)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [60, 61]
    assert D.overlaps(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == len(rows)
    assert D.overlaps(docs.limit(0), bench).count() == 0
