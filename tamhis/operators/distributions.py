"""Distributions of numeric columns.

Everything starts from the value-count table: (keys, value, n), one row per distinct value. It is
built by one pass with map-side counting, so hot values cost nothing, and all summaries read this
small table instead of the texts.

The keys of a series are its name and, optionally, a category. Series names are listed in the call, so
a table with one row per name, or one per value range of a name, has a fixed size bound and is
broadcast. With further keys the number of rows depends on the data and Spark picks the join by size.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128  # value ranges per series in the two-level running count


def _small(df: DataFrame, keys) -> DataFrame:
    """Broadcast a per-series table if its size bound is known."""
    return F.broadcast(df) if list(keys) == ["series"] else df


def value_counts(df: DataFrame, series: dict[str, Column], by=()) -> DataFrame:
    """(by.., series, value, n) for the named numeric expressions; nulls and NaN are left out."""
    wide = df.select(*by, *[c.cast("double").alias(name) for name, c in series.items()])
    return (
        wide.unpivot(list(by), list(series), "series", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "series", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def moments(vc: DataFrame, keys) -> DataFrame:
    """total, mean, lo, hi per series. One row per series."""
    return vc.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )


def _ranged(vc: DataFrame, keys) -> DataFrame:
    """Add ``_range``: which of about ``RANGES`` ranges, with equally many distinct values each, a value lies in.

    The edges are approximate quantiles of the distinct values, a bounded array per series.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    value = F.when(F.col("n") > 0, F.col("value"))  # reads the same columns as the other branches, to share their shuffle
    edges = vc.groupBy(*keys).agg(F.percentile_approx(value, shares, 20 * RANGES).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col("value")))
    # Never null, and said so: else the join puts a null filter below one branch's shuffle only.
    return vc.join(_small(edges, keys), keys).withColumn("_range", F.coalesce(below, F.lit(0))).drop("_edges")


def running_counts(vc: DataFrame, keys) -> DataFrame:
    """The value-count table with ``cum`` (rows up to and including the value) and the moments.

    Two levels: values fall into ranges, the range totals are summed up (a window over ``RANGES`` rows per
    series), and within a range a window adds up the distinct values. The ranges follow the data, so no task
    sorts a whole series, however close its values lie. All branches read the same columns of ``vc``, so its shuffle
    is run once and reused.
    """
    keys = list(keys)
    ranged = _ranged(vc, keys)
    series = Window.partitionBy(*keys)
    before = series.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("value")).alias("_nv"),
             F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        .select(
            *keys, "_range",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(series).alias("total"),
            (F.sum("_nv").over(series) / F.sum("_n").over(series)).alias("mean"),
            F.min("_lo").over(series).alias("lo"),
            F.max("_hi").over(series).alias("hi"),
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(_small(ranges, keys), [*keys, "_range"])
        .withColumn("cum", F.col("_before") + F.sum("n").over(inside))
        .drop("_range", "_before")
    )


#: Equal parts that a range is cut into when ranks are looked for.
PARTS = 4096
#: Ranges to a power of two.
FINE = 1024


def _floating_range(value: Column) -> tuple[Column, Column]:
    """(number, lower edge) of the range a number falls into: ``FINE`` ranges to a power of two. Numbers grow with the value."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    scale = F.pow(F.lit(2.0), power.cast("double"))
    step = F.floor((size / scale - 1.0) * FINE)
    finite = (size > 0) & (size < float("inf"))
    number = F.when(finite, (power + 1100) * FINE + step).when(size > 0, F.lit(2200 * FINE)).otherwise(F.lit(0)).cast("long")
    edge = F.when(finite, scale * (1.0 + step / FINE)).otherwise(size)
    # never null, and said so: else a join on it puts a null filter below one branch's shuffle only, which is then run twice
    return F.coalesce(F.when(value < 0, -number).otherwise(number), F.lit(0)), F.when(value < 0, -edge).otherwise(edge)


def _part(value: Column, lo: Column, hi: Column) -> Column:
    """Which of ``PARTS`` equal parts of [lo, hi] a value lies in."""
    share = (value - lo) / (hi - lo)
    return F.coalesce(F.when(hi > lo, F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).cast("long"), F.lit(0))


def _holding(ranks: Column, before: Column, n: Column) -> Column:
    """Those of some ranks (counted from 0) that fall among the ``n`` rows after ``before``."""
    return F.filter(ranks, lambda r: (r >= before) & (r < before + n))


def _ranges(vc: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """The counts with their range, and one row per range with the moments of its series.

    Squares are taken from each range's edge and shifted to the mean afterwards, so that nothing cancels.
    """
    value = F.col("value")
    number, edge = _floating_range(value)
    ranged = vc.withColumns({"_range": number, "_edge": edge})
    off = value - F.col("_edge")
    counts = ranged.groupBy(*keys, "_range", "_edge").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * off).alias("_off"), F.sum(F.col("n") * off * off).alias("_square"),
        F.sum(F.col("n") * value).alias("_nv"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    series = Window.partitionBy(*keys)
    shift = F.col("_edge") - F.col("mean")
    squares = F.sum(F.col("_square") + 2 * shift * F.col("_off") + F.col("_n") * shift * shift).over(series)
    return ranged, counts.withColumns({
        "total": F.sum("_n").over(series), "mean": F.sum("_nv").over(series) / F.sum("_n").over(series),
        "lo": F.min("_lo").over(series), "hi": F.max("_hi").over(series), "_first": F.min("_range").over(series),
        "_before": F.sum("_n").over(series.orderBy("_range")) - F.col("_n"),
    }).withColumn("std", F.when(F.col("total") > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (F.col("total") - 1))))


def spread(vc: DataFrame, keys) -> DataFrame:
    """(keys.., total, mean, std, lo, hi): one row per series."""
    return _ranges(vc, list(keys))[1].filter("_range = _first").select(*keys, "total", "mean", "std", "lo", "hi")


def selected(vc: DataFrame, keys, shares) -> DataFrame:
    """(keys.., total, mean, std, lo, hi, quantiles): moments, and exact quantiles at ``shares`` with linear interpolation.

    A selection, not a sort. Counts of fixed ranges (1,024 to a power of two, whatever the data) tell which ranges hold the
    wanted ranks; these alone, at most two per quantile, are cut into 4,096 equal parts and counted again; and
    only the parts that hold a wanted rank are sorted. Ranges and parts are counted map-side.
    """
    keys, value = list(keys), F.col("value")
    ranged, ranges = _ranges(vc, keys)
    at = [(F.col("total") - 1) * F.lit(float(q)) for q in shares]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    known = ranges.withColumn("_ranks", _holding(ranks, F.col("_before"), F.col("_n"))).filter(F.size("_ranks") > 0).select(
        *keys, "_range", "total", "mean", "std", "lo", "hi", "_lo", "_hi", "_before", "_ranks")
    carried = ["total", "mean", "std", "lo", "hi"]
    inside = ranged.join(_small(known, keys), [*keys, "_range"]).withColumn("_part", _part(value, F.col("_lo"), F.col("_hi")))
    of_range = Window.partitionBy(*keys, "_range").orderBy("_part")
    parts = (
        inside.groupBy(*keys, "_range", "_part", "_before", "_ranks").agg(F.sum("n").alias("_n"))
        .withColumn("_start", F.col("_before") + F.sum("_n").over(of_range) - F.col("_n"))
        .withColumn("_wanted", _holding(F.col("_ranks"), F.col("_start"), F.col("_n")))
        .filter(F.size("_wanted") > 0)
        .select(*keys, "_range", "_part", "_start", "_wanted")
    )
    of_part = Window.partitionBy(*keys, "_range", "_part").orderBy("value")
    found = (
        inside.join(_small(parts, keys), [*keys, "_range", "_part"])
        .withColumn("_up", F.col("_start") + F.sum("n").over(of_part) - F.col("n"))
        .select(*keys, *carried, "value", F.explode(_holding(F.col("_wanted"), F.col("_up"), F.col("n"))).alias("_rank"))
    )

    def quantile(x):
        low, high = (F.max(F.when(F.col("_rank") == f(x), F.col("value"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(x - F.floor(x))

    return found.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], F.array(*[quantile(x) for x in at]).alias("quantiles"))


def describe(vc: DataFrame, keys=("series",)) -> DataFrame:
    """count, mean, std (n - 1), min, exact quartiles, max per series."""
    q = F.col("quantiles")
    return selected(vc, keys, (0.25, 0.5, 0.75)).select(
        *keys, F.col("total").alias("count"), "mean", "std", F.col("lo").alias("min"),
        q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.col("hi").alias("max"))


def ecdf(vc: DataFrame, keys=("series",)) -> DataFrame:
    """Share of rows up to each distinct value."""
    return running_counts(vc, keys).select(
        *keys, "value", "n", (F.col("cum") / F.col("total")).alias("share")
    )


def boxplot(vc: DataFrame, keys=("series",), reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last values within ``reach`` * IQR of the box) and number of outliers."""
    keys = list(keys)
    fence = F.lit(reach) * (F.col("q3") - F.col("q1"))
    box = (
        describe(vc, keys).select(*keys, "count", "q1", "median", "q3")
        .withColumns({"low_fence": F.col("q1") - fence, "high_fence": F.col("q3") + fence})
    )
    value = F.col("value")
    inside = value.between(F.col("low_fence"), F.col("high_fence"))
    return (
        vc.join(_small(box, keys), keys)
        .groupBy(*keys, "count", "q1", "median", "q3")
        .agg(
            F.least(F.min(F.when(inside, value)), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, value)), F.col("q3")).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def _bin(value: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Index of the equal-width bin [edge, next edge); the last bin includes its upper edge."""
    guess = F.least(F.floor((value - lo) / width), bins - 1)
    return F.when(width <= 0, F.lit(0)).otherwise(
        guess
        - F.when(value < lo + guess * width, 1).otherwise(0)
        + F.when((guess < bins - 1) & (value >= lo + (guess + 1) * width), 1).otherwise(0)
    ).cast("long")


def histogram(vc: DataFrame, keys=("series",), whole: bool = True) -> DataFrame:
    """Equal-width histogram with the automatic bin rule; empty bins are listed.

    Width = min(max(Freedman-Diaconis, half the square-root rule), Sturges); at least 1 for ``whole`` numbers (columns of an
    integer type), any positive number for others.
    """
    keys = list(keys)
    n, span = F.col("count").cast("double"), F.col("max") - F.col("min")
    width = F.least(
        F.greatest(2.0 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3.0)), span / F.sqrt(n) / 2.0),
        span / (F.log2(n) + 1.0),
    )
    width = F.greatest(width, F.lit(1.0)) if whole else width
    bins = F.when((span > 0) & (width > 0), F.ceil(span / width)).otherwise(F.lit(1)).cast("long")
    shape = describe(vc, keys).select(
        *keys, F.col("min").alias("lo"), bins.alias("bins"), (span / bins).alias("width")
    )
    counts = (
        vc.join(_small(shape, keys), keys)
        .groupBy(*keys, _bin(F.col("value"), F.col("lo"), F.col("width"), F.col("bins")).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    every_bin = shape.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    return every_bin.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


#: Terms of a box's series, and bandwidths beyond which a box adds nothing. With boxes one bandwidth wide the rest
#: of the series is below 4e-12, and the kernel at that distance below 1e-16, of the kernel's height per value.
KDE_TERMS, KDE_REACH = 16, 9.5


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients, by power, of the polynomials He_0 .. with exp(tu - u²/2) = sum of He_j(t) u^j / j!."""
    rows = [[1], [0, 1]]
    for j in range(1, terms - 1):
        last, before = [0, *rows[j]], [*rows[j - 1], 0, 0]
        rows.append([a - j * b for a, b in zip(last, before)])
    return rows[:terms]


def _boxes(vc: DataFrame, shape: DataFrame, keys) -> DataFrame:
    """Values gathered in boxes one bandwidth wide: the box's middle and the coefficients of its sum of kernels.

    With u the distance of a value from the middle and t that of a point, in bandwidths, the kernels of a box add up to
    exp(-t²/2) times a polynomial in t whose coefficients are combinations of the sums of n u^j / j!.
    """
    box = F.floor((F.col("value") - F.col("min")) / F.col("bw"))
    middle = F.col("min") + (F.col("_box") + 0.5) * F.col("bw")
    u = (F.col("value") - middle) / F.col("bw")
    moments = [F.expr(f"sum(n * pow(_u, {j}D) / {math.factorial(j)}D)").alias(f"_m{j}") for j in range(KDE_TERMS)]
    sums = (
        vc.join(_small(shape, keys), keys).withColumn("_box", box).withColumn("_u", u)
        .groupBy(*keys, "_box", middle.alias("_middle"), "bw", "start", "step").agg(*moments)
    )
    rows = _hermite(KDE_TERMS)
    powers = [
        F.expr(" + ".join(f"{rows[j][k]}D * _m{j}" for j in range(k, KDE_TERMS) if rows[j][k])).alias(f"_c{k}")
        for k in range(KDE_TERMS)
    ]
    return sums.select(*keys, "_middle", "bw", "start", "step", *powers)


def _reached(boxes: DataFrame, points: int) -> DataFrame:
    """One row per box and grid point within its reach. The fewer boxes, the more points each one reaches: rows grow with the
    number of boxes plus a constant, not with distinct values times points."""
    reach = F.lit(KDE_REACH + 0.5) * F.col("bw")
    first = F.greatest(F.ceil((F.col("_middle") - reach - F.col("start")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((F.col("_middle") + reach - F.col("start")) / F.col("step")), F.lit(points - 1))
    return (
        boxes.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
        .withColumn("point", F.explode(F.sequence("_first", "_last")))
    )


def kde(vc: DataFrame, keys=("series",), points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density with Scott's bandwidth on an even grid, ``cut`` bandwidths past the data.

    Values are first gathered in boxes one bandwidth wide (counted map-side), each with a series of 16 terms; a box then
    adds to the grid points within its reach. The result differs from the sum over all values by less than
    1e-11 of the kernel's height. Series without spread have no density.
    """
    keys = list(keys)
    shape = (
        spread(vc, keys)
        .select(*keys, "total", F.col("lo").alias("min"), F.col("hi").alias("max"),
                (F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("bw"))
        .filter((F.col("bw") > 0) & (F.col("bw") < float("inf")))
        .select(*keys, "total", "bw", "min",
                (F.col("min") - F.lit(cut) * F.col("bw")).alias("start"),
                ((F.col("max") - F.col("min") + F.lit(2.0 * cut) * F.col("bw")) / F.lit(points - 1.0)).alias("step"))
    )
    reached = _reached(_boxes(vc, shape, keys), points)
    t = (F.col("start") + F.col("point") * F.col("step") - F.col("_middle")) / F.col("bw")
    polynomial = f"_c{KDE_TERMS - 1}"
    for k in range(KDE_TERMS - 2, -1, -1):
        polynomial = f"({polynomial}) * _t + _c{k}"
    sums = (
        reached.withColumn("_t", t)
        .groupBy(*keys, "point").agg(F.expr(f"sum(exp(-0.5D * _t * _t) * ({polynomial}))").alias("_s"))
    )
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    return grid.join(sums, [*keys, "point"], "left").select(
        *keys, "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0)) / (F.col("total") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def violin(vc: DataFrame, keys=("series",)) -> DataFrame:
    """Density outline with the quartiles on every row."""
    box = describe(vc, keys).select(*keys, "q1", "median", "q3")
    return kde(vc, keys, points=100, cut=2.0).join(_small(box, keys), list(keys))


def mean_interval(df: DataFrame, value: str, by: str, z: float = 1.96) -> DataFrame:
    """Mean and normal-approximation 95 % interval per group."""
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.avg(value) - half).alias("ci_low"),
        (F.avg(value) + half).alias("ci_high"),
    )


def _poisson_limits(bits: int = 32) -> list[int]:
    """Limits of the Poisson(1) distribution function on ``bits``-bit numbers; the rest beyond them is nil."""
    total, term, limits = 0.0, math.exp(-1), []
    for k in range(1, 13):
        total += term
        term /= k
        limits.append(math.floor(total * 2**bits))
    return limits


POISSON_LIMITS = _poisson_limits()


def mean_interval_bootstrap(df: DataFrame, value: str, by: str, key: str, draws: int = 1000, buckets: int = 100,
                            seed: int = 42) -> DataFrame:
    """Mean and percentile 95 % interval per group by a bucketed bootstrap.

    Rows are summed up in a fixed number of buckets by md5(seed, key). In each draw a bucket counts as often as
    a Poisson(1) number taken from md5(seed, draw, bucket) says. Everything is a fixed function of the keys,
    so the interval does not depend on partitioning, and the work after the first sum does not grow with the rows.
    """
    def number(*parts):
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")

    rows = df.filter(F.col(value).isNotNull()).select(
        by, F.col(value).cast("double").alias("v"), F.pmod(number(F.col(key).cast("string")), F.lit(buckets)).alias("bucket"))
    sums = rows.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = number(F.col("draw").cast("string"), F.col("bucket").cast("string"))
    weight = sum(((F.col("u") >= limit).cast("long") for limit in POISSON_LIMITS), F.lit(0).cast("long"))
    means = (
        drawn.withColumn("u", u).withColumn("w", weight)
        .groupBy(by, "draw").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
        .groupBy(by)  # exactly `draws` rows per group
        .agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    )
    whole = sums.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(means, by)


def grid_counts(df: DataFrame, pairs, bins: int = 50) -> DataFrame:
    """Two-dimensional bin counts (x, y, x_bin, y_bin, n) for pairs of numeric columns.

    Stands in for scatter plots, whose point clouds grow with the data. The column ranges are taken
    in a pass of their own and enter as a one-row subquery, so pass a stored table of the measures.
    """
    columns = sorted({c for pair in pairs for c in pair})
    numbers = df.select([F.col(c).cast("double").alias(c) for c in columns])
    ranges = numbers.agg(F.struct(
        *[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]
    ).alias("r")).select("r").scalar()

    def index(c):
        lo, hi = F.col("r")[f"{c}_lo"], F.col("r")[f"{c}_hi"]
        return _bin(F.col(c), lo, (hi - lo) / F.lit(float(bins)), F.lit(bins))

    def cell(x, y):
        return F.when(F.col(f"{x}_bin").isNotNull() & F.col(f"{y}_bin").isNotNull(), F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"),
            F.col(f"{x}_bin").alias("x_bin"), F.col(f"{y}_bin").alias("y_bin"),
        ))

    # Rows are first counted by all their bins, and only those counts are dealt to the pairs.
    binned = [F.when(F.col(c).isNotNull(), index(c)).alias(f"{c}_bin") for c in columns]
    return (
        numbers.withColumn("r", ranges).select(*binned)
        .groupBy(*[f"{c}_bin" for c in columns]).agg(F.count(F.lit(1)).alias("n"))
        .select("n", F.explode(F.array(*[cell(x, y) for x, y in pairs])).alias("c"))
        .filter("c is not null")
        .groupBy("c.x", "c.y", "c.x_bin", "c.y_bin")
        .agg(F.sum("n").alias("n"))
    )
