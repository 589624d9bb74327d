import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamhis.operators import counts as N
from tamhis.operators import distributions as D


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    return {
        "long": np.round(rng.lognormal(5, 1, 3000)).astype(int),
        "few": np.array([1, 1, 2, 7, 7, 7, 50]),
        "flat": np.array([4, 4, 4]),
        "negative": rng.integers(-500, 500, 997),
    }


@pytest.fixture(scope="module")
def vc(spark, values):
    rows = [(s, float(v)) for s, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "s string, v double")
    return D.value_counts(df, {s: F.when(F.col("s") == s, F.col("v")) for s in values}).cache()


def by_series(df):
    return {k: g.reset_index(drop=True) for k, g in df.toPandas().groupby("series")}


def test_describe_equals_pandas(vc, values):
    got = by_series(D.describe(vc))
    for s, v in values.items():
        want = pd.Series(v).describe()
        row = got[s].iloc[0]
        for ours, theirs in zip(["count", "mean", "std", "min", "q1", "median", "q3", "max"], want):
            assert row[ours] == pytest.approx(theirs, rel=1e-12)


def test_histogram_equals_numpy(vc, values):
    got = by_series(D.histogram(vc))
    for s in ("long", "few", "negative"):
        counts, edges = np.histogram(values[s], bins="auto")
        table = got[s].sort_values("bin")
        assert table["n"].tolist() == counts.tolist()
        assert np.allclose(table["left"], edges[:-1]) and np.allclose(table["right"], edges[1:])
    assert got["flat"]["n"].tolist() == [3]


def test_ecdf(vc, values):
    got = by_series(D.ecdf(vc))
    for s, v in values.items():
        table = got[s].sort_values("value")
        assert table["share"].tolist() == pytest.approx([(v <= x).mean() for x in table["value"]])
        assert table["share"].iloc[-1] == 1.0


def test_kde(vc, values):
    got = by_series(D.kde(vc, points=50, cut=2.0))
    assert "flat" not in got
    for s in ("long", "few", "negative"):
        v = values[s].astype(float)
        bw = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 2 * bw, v.max() + 2 * bw, 50)
        want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        table = got[s].sort_values("point")
        assert np.allclose(table["x"], x) and np.allclose(table["density"], want)


@pytest.fixture(scope="module")
def real(spark):
    """Continuous columns: nearly every value is distinct."""
    rng = np.random.default_rng(8)
    return {
        "normal": rng.normal(3, 2, 4000), "heavy": np.exp(rng.normal(0, 5, 4000)), "stamps": 1.7e9 + rng.random(4000) * 1e5,
        "mixed": np.concatenate([-np.exp(rng.normal(0, 30, 500)), np.zeros(1500), np.exp(rng.normal(0, 30, 500)), [5e-324, -5e-324, 1e308]]),
        "powers": 2.0 ** rng.integers(-60, 60, 3000), "two": np.array([1.5, np.nextafter(1.5, 2)]), "one": np.array([-7.25]),
    }


@pytest.fixture(scope="module")
def real_vc(spark, real):
    df = spark.createDataFrame([(s, float(v)) for s, vs in real.items() for v in vs], "s string, v double").repartition(6)
    return D.value_counts(df, {s: F.when(F.col("s") == s, F.col("v")) for s in real}).cache()


def test_selected_quantiles_of_real_numbers(real_vc, real):
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = by_series(D.selected(real_vc, ["series"], shares))
    assert set(got) == set(real)
    for s, v in real.items():
        row = got[s].iloc[0]
        assert row["total"] == len(v) and (row["lo"], row["hi"]) == (v.min(), v.max())
        exact = np.sort(v)
        at = np.array(shares) * (len(v) - 1)
        low, high = exact[np.floor(at).astype(int)], exact[np.ceil(at).astype(int)]
        assert list(row["quantiles"]) == pytest.approx((low + (high - low) * (at - np.floor(at))).tolist(), rel=1e-12)
        assert row["mean"] == pytest.approx(v.mean(), rel=1e-9)
        if len(v) > 1 and s not in ("two", "mixed"):
            assert row["std"] == pytest.approx(v.std(ddof=1), rel=1e-9)


def test_quantiles_are_selected_not_sorted(real_vc):
    df = D.describe(real_vc)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    orders = [line for line in plan.splitlines() if "Window [" in line and "value#" in line.rpartition("[")[2]]
    assert orders and all("_part#" in line for line in orders)  # values are only ordered within a part of a range
    # what is left to sort: of 4,000 timestamps close together, those in a few of 4,096 parts
    stamps = real_vc.filter("series = 'stamps'")
    number, _ = D._floating_range(F.col("value"))
    assert stamps.select(number.alias("r")).distinct().count() <= 2
    lo, hi = stamps.agg(F.min("value"), F.max("value")).first()
    part = D._part(F.col("value"), F.lit(lo), F.lit(hi))
    assert stamps.groupBy(part.alias("p")).count().agg(F.max("count")).first()[0] < 20


def test_ranges_grow_with_the_values(spark):
    edges = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-3, 1.0, np.nextafter(2.0, 1), 2.0, 1e22, 2.0 ** 52, 1.7e308, float("inf")]
    values = sorted({s * e for e in edges for s in (-1.0, 1.0)} | {float(x) for k in range(-40, 40) for x in (2.0 ** k, np.nextafter(2.0 ** k, 0), 1.37 * 2.0 ** k)})
    number, edge = D._floating_range(F.col("v"))
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", number.alias("r"), edge.alias("e")).orderBy("v").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows)
    assert all(abs(r.e) <= abs(r.v) and abs(r.v - r.e) <= abs(r.v) / 500 for r in rows if 1e-300 < abs(r.v) < float("inf"))


def test_kde_of_real_numbers(real_vc, real):
    """The distance from the sum over all values stays below the stated bound."""
    keep = ["normal", "heavy", "stamps"]
    got = by_series(D.kde(real_vc.filter(F.col("series").isin(keep)), points=120))
    for s in keep:
        v = real[s]
        bw = v.std(ddof=1) * len(v) ** -0.2
        table = got[s].sort_values("point")
        x = table["x"].to_numpy()
        assert len(x) == 120 and x[0] == pytest.approx(v.min() - 3 * bw, rel=1e-9)
        exact = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        height = 1 / (bw * math.sqrt(2 * math.pi))
        assert np.abs(table["density"] - exact).max() < 2e-9 * height  # x itself is rounded: timestamps have 1e-7 of a second
        if s != "stamps":
            assert np.abs(table["density"] - exact).max() < 1e-11 * height


def test_kde_rows_do_not_multiply(real_vc):
    """Neither the boxes nor what they reach come near distinct values times points."""
    for s, most in (("normal", 4000), ("stamps", 4000), ("heavy", 6000)):
        vc = real_vc.filter(F.col("series") == s)
        shape = D.spread(vc, ["series"]).select(
            "series", "total", F.col("lo").alias("min"), (F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("bw"),
            F.col("lo").alias("start"), ((F.col("hi") - F.col("lo")) / 199.0).alias("step"))
        boxes = D._boxes(vc, shape, ["series"])
        assert boxes.count() <= 400 and D._reached(boxes, 200).count() <= most  # of 800,000


def test_histogram_of_real_numbers(real_vc, real):
    got = by_series(D.histogram(real_vc.filter("series in ('normal', 'stamps', 'one')"), whole=False))
    for s in ("normal", "stamps"):
        counts, edges = np.histogram(real[s], bins="auto")
        table = got[s].sort_values("bin")
        assert table["n"].tolist() == counts.tolist() and np.allclose(table["left"], edges[:-1])
    assert got["one"]["n"].tolist() == [1]


def test_boxplot(vc, values):
    got = by_series(D.boxplot(vc))
    for s, v in values.items():
        q1, q3 = np.percentile(v, [25, 75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        row = got[s].iloc[0]
        assert row["whisker_low"] == min(inside.min(), q1) and row["whisker_high"] == max(inside.max(), q3)
        assert row["outliers"] == len(v) - len(inside)


def test_violin_has_quartiles_on_every_point(vc):
    got = by_series(D.violin(vc))
    assert len(got["long"]) == 100 and got["long"]["median"].nunique() == 1


def test_single_row_has_no_deviation(spark):
    vc = D.value_counts(spark.createDataFrame([(3.0,), (None,), (float("nan"),)], "v double"), {"v": F.col("v")})
    row = D.describe(vc).first()
    assert (row["count"], row["std"], row["median"]) == (1, None, 3.0)


@pytest.mark.parametrize("low, high", [(0.0, 0.01), (36.5, 37.5)])
def test_ranges_follow_the_data(spark, low, high):
    """However close the values lie, no range holds more than a small share of them."""
    vc = spark.range(100_000).select(F.lit("v").alias("series"), (low + (high - low) * F.rand(3)).alias("value"), F.lit(1).cast("long").alias("n"))
    sizes = [r["count"] for r in D._ranged(vc, ["series"]).groupBy("_range").count().collect()]
    assert len(sizes) > 0.9 * D.RANGES and max(sizes) < 2.5 * sum(sizes) / D.RANGES


def test_empty_input(spark):
    vc = D.value_counts(spark.createDataFrame([], "v double"), {"v": F.col("v")})
    assert D.describe(vc).count() == D.histogram(vc).count() == D.ecdf(vc).count() == 0


def test_bootstrap_is_close_to_normal_and_independent_of_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in np.round(rng.normal(100, 20, 5000))] + [("b", 5.0)] * 10 + [("b", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, category string, v double")
    normal = {r.category: r for r in D.mean_interval(df, "v", "category").collect()}
    runs = []
    for partitions in (1, 5):
        found = D.mean_interval_bootstrap(df.repartition(partitions), "v", "category", "id")
        runs.append({r.category: r for r in found.collect()})
    first, second = runs
    assert first["a"].mean == pytest.approx(normal["a"].mean)
    assert first["a"].ci_low == pytest.approx(normal["a"].ci_low, abs=0.15)
    assert first["a"].ci_high == pytest.approx(normal["a"].ci_high, abs=0.15)
    assert first["a"].ci_low == pytest.approx(second["a"].ci_low, rel=1e-9)
    assert (first["b"].ci_low, first["b"].ci_high) == (5.0, 5.0)


def test_grid_counts_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1000, 2000), rng.integers(5, 300, 2000)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(None, 6)], "x long, y long")
    got = D.grid_counts(df, [("x", "y"), ("y", "x")], 10).toPandas()
    want, _, _ = np.histogram2d(x, y, bins=10)
    table = np.zeros((10, 10))
    for r in got[got.x == "x"].itertuples():
        table[r.x_bin, r.y_bin] = r.n
    assert (table == want).all()
    assert got.n.sum() == 4000


def test_correlations_are_pairwise_complete(spark):
    data = pd.DataFrame({"a": [1.0, 2, 3, None], "b": [2.0, 1, 5, 9], "c": [None] * 4, "d": [None, None, 1.0, 2.0]})
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in data.itertuples(index=False)]
    got = {(r.x, r.y): r.r for r in N.correlations(spark.createDataFrame(rows, "a double, b double, c double, d double"),
                                                    ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16
    assert got["a", "b"] == pytest.approx(data["a"].corr(data["b"])) == got["b", "a"]
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] is None and got["c", "c"] is None
