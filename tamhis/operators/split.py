"""Exact, deterministic train/test split."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4  # hex digits: 65,536 ranges of the digest


def split_exact(df: DataFrame, key: str, test_share: float = 0.05, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ceil(test_share * n) rows are 'test', the others 'train'.

    The test rows are the first ones by (md5(seed, key), key); ``key`` must be unique. The data is
    neither sorted nor shuffled: a count per digest prefix tells in which prefix the boundary lies,
    only rows with that prefix (one in 65,536) are ranked, and the boundary row enters the final
    projection as a one-row subquery.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keys = df.select(F.col(key).alias("k"), digest.alias("d")).withColumn("p", F.substring("d", 1, PREFIX_DIGITS))
    in_order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = keys.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    total = prefixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    wanted = total.select(F.ceil(F.col("t") * F.lit(float(test_share))).alias("w")).select("w").scalar()
    boundary = (  # a window over at most 65,536 counts
        prefixes.withColumn("upto", F.sum("n").over(in_order))
        .withColumn("wanted", wanted)
        .filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select("p", (F.col("wanted") - F.col("upto") + F.col("n")).alias("rank"))
    )
    rank = F.row_number().over(Window.partitionBy("p").orderBy("d", "k"))
    last_test_row = (
        keys.join(F.broadcast(boundary), "p")
        .withColumn("_r", rank).filter("_r = rank")
        .select(F.struct("d", "k").alias("last")).select("last").scalar()
    )
    is_test = F.struct(digest.alias("d"), F.col(key).alias("k")) <= last_test_row
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))
