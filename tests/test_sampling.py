from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tamhis.operators import sampling as S


def plain(rows, k, seed=42):
    groups = {}
    for i, g in rows:
        groups.setdefault(g, []).append(i)
    return {g: sorted(own, key=lambda i: md5(f"{seed}:{i}".encode()).hexdigest())[:k] for g, own in groups.items()}


ROWS = [(i, None if i % 50 == 1 else "hot" if i % 3 == 0 else f"g{i % 7}" if i < 2000 else f"rare{i}") for i in range(2100)]


@pytest.mark.parametrize("k, digits, groups", [(10, 4, 100_000), (10, 1, 0), (1, 2, 100_000), (5000, 4, 0)])
def test_exactly_the_smallest_hashes(spark, monkeypatch, k, digits, groups):
    monkeypatch.setattr(S, "PREFIX_DIGITS", digits)
    df = spark.createDataFrame(ROWS, "i long, g string").withColumn("v", F.col("i") * 2).repartition(7)
    got = {}
    for r in S.hash_sample(df, "i", k, ["g"], broadcast_groups=groups).collect():
        assert r.v == 2 * r.i
        got.setdefault(r.g, []).append(r.i)
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x) for g, x in plain(ROWS, k).items()}


def test_days_merge(spark):
    df = spark.createDataFrame(ROWS, "i long, g string")
    whole = S.hash_sample(df, "i", 12, ["g"])
    days = [S.hash_sample(df.filter(F.col("i") % 3 == d), "i", 12, ["g"]) for d in range(3)]
    merged = S.hash_sample(days[0].union(days[1]).union(days[2]), "i", 12, ["g"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame(ROWS, "i long, g string")
    assert sorted(r.i for r in S.hash_sample(df, "i", 25, seed=7).collect()) == sorted(plain([(i, 0) for i, _ in ROWS], 25, 7)[0])
    assert S.hash_sample(df.limit(0), "i", 25).count() == 0


def test_few_rows_are_ranked(spark):
    """Rows beyond the prefix that holds the k-th one are dropped before they are shuffled."""
    df = spark.range(300_000).select(F.col("id").alias("i"))
    sample = S.hash_sample(df, "i", 100)
    assert sample.count() == 100
    first = max(md5(f"42:{r.i}".encode()).hexdigest()[:4] for r in sample.collect())
    assert df.filter(F.substring(S._hash(F.col("i"), 42), 1, 4) <= first).count() < 130
