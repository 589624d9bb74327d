"""Counts, categories, words and column profiles."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamhis.functions import text as X
from tamhis.operators.curation import digest


def column_profile(df: DataFrame, stages=None) -> DataFrame:
    """(stage, column, dtype, n, non_null, nulls), from one pass over the table.

    ``stages`` maps a name to (row condition or None, columns); by default one stage has all.
    """
    stages = stages or {"all_rows": (None, df.columns)}
    dtypes = dict(df.dtypes)
    entries = []
    for stage, (where, columns) in stages.items():
        where = F.lit(True) if where is None else where
        n = F.count_if(where)
        for c in columns:
            non_null = F.count_if(where & F.col(c).isNotNull())
            entries.append(F.struct(
                F.lit(stage).alias("stage"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                n.alias("n"), non_null.alias("non_null"), (n - non_null).alias("nulls"),
            ))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def duplicate_rows(df: DataFrame, columns) -> DataFrame:
    """Rows, distinct rows and surplus copies; nulls are equal to each other.

    Digests are shuffled instead of the texts, one per distinct row and map task.
    """
    return (
        df.select(digest(*columns).alias("d"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("d").alias("n_distinct"))
        .withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))
    )


def category_counts(df: DataFrame, column: str = "category", none_label: str | None = None) -> DataFrame:
    """Rows per category; nulls are dropped, or counted under ``none_label`` if one is given."""
    value = F.col(column) if none_label is None else F.coalesce(F.col(column), F.lit(none_label))
    return (
        df.select(value.alias(column)).na.drop(subset=[column])
        .groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )


def top(counts: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` largest counts; ties go to the smaller name."""
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def in_top_categories(df: DataFrame, k: int = 6, column: str = "category") -> DataFrame:
    """Rows of the ``k`` most frequent categories. The broadcast side has ``k`` rows."""
    names = top(category_counts(df, column), column, k).select(column)
    return df.join(F.broadcast(names), column, "left_semi")


def category_share(df: DataFrame, k: int = 6, column: str = "category", other: str = "Other") -> DataFrame:
    """The ``k`` largest categories and the rest as one row (left out if empty), in percent.

    ``is_rest`` tells the rest apart from a real category of the same name.
    """
    counts = category_counts(df, column)
    leaders = top(counts, column, k).select(column, F.lit(False).alias("is_rest"))
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    return (
        counts.join(F.broadcast(leaders), column, "left")
        .groupBy(
            F.when(F.col("is_rest").isNull(), F.lit(other)).otherwise(F.col(column)).alias("label"),
            F.col("is_rest").isNull().alias("is_rest"),
        )
        .agg(F.sum("n").alias("n"))
        .withColumn("percent", F.round(100.0 * F.col("n") / total, 1))
    )


#: Values that a frequent-items summary keeps, and those of them that are counted again.
TRACKED, CANDIDATES = 10_000, 1000


def _summary_error(tracked: int) -> float:
    """Largest part of all rows by which a summary of so many values may misjudge a count: 3.5 to the size of its table, which
    is the power of two that so many values fill to three quarters."""
    return 3.5 / (1 << math.ceil(math.log2(tracked / 0.75)))


def top_values(df: DataFrame, column: str, k: int, tracked: int = TRACKED, candidates: int = CANDIDATES) -> tuple[DataFrame, bool]:
    """The ``k`` most frequent values with their exact counts (``column``, n), and whether the summary proved them.

    A first pass builds mergeable frequent-items summaries of fixed size, one a task, so no vocabulary is shuffled.
    Their candidates are counted exactly in a second pass: map-side, some thousand rows a task. No other value can be more
    frequent than the summary's estimate of the last candidate or its error bound; if the k-th count is above both, the
    result is proven. Else (a flat distribution, or few values) everything is counted, as ``top`` of plain counts.
    """
    values = df.select(column).filter(F.col(column).isNotNull())
    found = values.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{column}`, {candidates}, {tracked})").alias("top")).first()
    listed = [(r["item"], r["count"]) for r in found["top"]]
    if listed:
        names = df.sparkSession.createDataFrame([(v,) for v, _ in listed], values.schema)
        exact = top(values.join(F.broadcast(names), column, "left_semi").groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, k)
        schema, rows = exact.schema, exact.collect()
        bound = max(found["n"] * _summary_error(tracked), listed[-1][1] if len(listed) == candidates else 0)
        if len(rows) == k and rows[-1]["n"] > bound:
            return df.sparkSession.createDataFrame(rows, schema), True
    return top(values.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, k), False


def words_of(text: Column) -> Column:
    """Array of the parts of a text between white space, an empty one at either end if there is white space."""
    return F.split(text, f"{X.WS}++")


def top_words(df: DataFrame, column: str, k: int = 10, longer_than: int = 2) -> DataFrame:
    """Most frequent words of a text column; case and punctuation are kept. ``df`` is read twice.

    Splitting leaves empty strings at the ends, which the length filter drops.
    """
    words = df.select(F.explode(words_of(F.col(column))).alias("word"))
    return top_values(words.filter(F.length("word") > longer_than), "word", k)[0]


def correlations(df: DataFrame, columns) -> DataFrame:
    """Pearson matrix in long form (x, y, r), pairwise complete, from one pass."""
    columns = list(columns)
    clean = df.select([F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    row = clean.agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    long = row.unpivot([], [f"{x}|{y}" for x, y in pairs], "pair", "r")
    both = F.array(
        F.struct(F.split_part("pair", F.lit("|"), F.lit(1)).alias("x"),
                 F.split_part("pair", F.lit("|"), F.lit(2)).alias("y")),
        F.struct(F.split_part("pair", F.lit("|"), F.lit(2)).alias("x"),
                 F.split_part("pair", F.lit("|"), F.lit(1)).alias("y")),
    )
    return long.select(F.explode(F.array_distinct(both)).alias("p"), "r").select("p.x", "p.y", "r")
