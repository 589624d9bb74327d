import random

import pytest
from pyspark.sql import functions as F

from tamhis.operators import counts as N


def frame(spark, categories):
    return spark.createDataFrame([(c,) for c in categories], "category string")


def test_share_keeps_a_real_other_apart(spark):
    names = ["a"] * 9 + ["b"] * 8 + ["c"] * 7 + ["d"] * 6 + ["e"] * 5 + ["Other"] * 4 + ["x"] * 2 + ["y"] + [None] * 3
    got = {(r.label, r.is_rest): (r.n, r.percent) for r in N.category_share(frame(spark, names)).collect()}
    assert got["Other", False] == (4, 9.5) and got["Other", True] == (3, 7.1)
    assert len(got) == 7


def test_share_without_rest(spark):
    assert [r.is_rest for r in N.category_share(frame(spark, ["a", "b"])).collect()] == [False, False]


def test_counts_with_and_without_nulls(spark):
    df = frame(spark, ["a", None, "a", None, "b"])
    assert dict(N.category_counts(df).collect()) == {"a": 2, "b": 1}
    assert dict(N.category_counts(df, none_label="None").collect()) == {"a": 2, "b": 1, "None": 2}


def test_top_breaks_ties_by_name(spark):
    df = frame(spark, list("bbaacc") + ["d"])
    assert [r.category for r in N.top(N.category_counts(df), "category", 2).collect()] == ["a", "b"]
    assert N.in_top_categories(df, 2).count() == 4


def test_words(spark):
    df = spark.createDataFrame([(" the cat\tthe  ox ",), ("The cat, the end",), (None,), ("",)], "t string")
    assert [tuple(r) for r in N.top_words(df, "t", 2).collect()] == [("the", 3), ("The", 1)]


def test_column_profile_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), (None, None), (None, None)], "x string, y double")
    assert [tuple(r) for r in N.column_profile(df).collect()] == [
        ("all_rows", "x", "string", 5, 3, 2), ("all_rows", "y", "double", 5, 2, 3)]
    staged = N.column_profile(df, {"s": (F.col("x").isNotNull(), ["y"])}).collect()
    assert [tuple(r) for r in staged] == [("s", "y", "double", 3, 2, 1)]
    assert tuple(N.duplicate_rows(df, ["x", "y"]).first()) == (5, 3, 2)
    assert tuple(N.duplicate_rows(df.limit(0), ["x", "y"]).first()) == (0, 0, 0)


def _plain_top(values, k):
    from collections import Counter
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


def test_top_values_of_a_skewed_vocabulary_are_proven(spark):
    rng = random.Random(1)
    values = [f"common{min(int(rng.expovariate(0.5)), 30)}" if rng.random() < 0.4 else f"rare{rng.randint(0, 60_000)}" for _ in range(40_000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v string").repartition(6)
    got, proven = N.top_values(df, "v", 5, tracked=500, candidates=50)
    assert proven and [tuple(r) for r in got.collect()] == _plain_top(values, 5)


def test_top_values_of_a_flat_vocabulary_are_counted(spark):
    rng = random.Random(2)
    values = [f"w{rng.randint(0, 20_000)}" for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    got, proven = N.top_values(df, "v", 10, tracked=500, candidates=50)
    assert not proven and [tuple(r) for r in got.collect()] == _plain_top(values, 10)


@pytest.mark.parametrize("values", [[], [None], ["a"], ["a", "b", "b"], ["x"] * 100 + ["y"] * 100 + ["z"] * 100])
def test_top_values_of_few(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got, _ = N.top_values(df, "v", 2)
    assert [tuple(r) for r in got.collect()] == _plain_top(values, 2) and got.columns == ["v", "n"]


def test_the_vocabulary_is_not_shuffled(spark):
    """A proven result is as many rows as were asked for; nothing of the words is left in the plan."""
    df = spark.createDataFrame([("the cat the dog the cat and more",)] * 500, "t string")
    got = N.top_words(df, "t", 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert [tuple(r) for r in got.collect()] == [("the", 1500), ("cat", 1000)]
