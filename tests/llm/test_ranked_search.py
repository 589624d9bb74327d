import math
import random
import re
from collections import Counter

import pytest

import tamhis.llm.ranked_search as R

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    """Every score by the formulas."""
    found = [(d, Counter(TERM.findall((t or "").encode().lower()))) for d, t in docs]
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").encode().lower()))
    n_docs, n_terms = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for i, terms in asked.items():
        rows = []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                for w, q in terms.items() if c[w])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, shard, bundle_owners", [(1, 8192, 4), (2, 300, 1), (3, 264, 7)])
def test_equals_all_scores(spark, monkeypatch, seed, shard, bundle_owners):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ÉA", "été", "日本", "x-Y", "Common"]

    def text(n):
        return " ".join("Common" if rng.random() < 0.3 else rng.choice(words) for _ in range(n))

    docs = [(i, text(rng.randint(0, 40))) for i in range(900)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5, "w1 w2"), (7, None), (8, ""), (9, " \t-"), (10, "w3 " * 3000), *docs[:50]]
    items = [(i, text(rng.randint(1, 8))) for i in range(150)]
    items += [(None, "w1 w1 w2"), (200, None), (201, ""), (202, "nothing of this"), items[0], items[0], (1, "W5 w5")]
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS term").repartition(3)
    items_df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS `key`")
    got = R.search(docs_df, items_df, k=7, owners=bundle_owners)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert R.search(docs.limit(0), items).count() == 0 and R.search(docs, items.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert R.search(nothing, items).count() == 0
    assert [tuple(r) for r in R.search(docs.withColumnRenamed("doc_id", "rank"), items, key="rank").collect()] == plain([(1, "a b")], [(1, "a b c")], 20)


def test_filter_passes_every_item_term(spark):
    uses = spark.createDataFrame([(1, bytearray(f"t{i}".encode()), 1) for i in range(3000)], "item long, term binary, q long")
    words = R._Words(R._filter(uses))
    assert all(words[f"t{i}".encode()] >= 0 for i in range(3000))
    assert sum(words[f"u{i}".encode()] >= 0 for i in range(3000)) < 30
