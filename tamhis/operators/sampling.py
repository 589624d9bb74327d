"""Samples of rows by hash: the same rows whatever the partitioning, and mergeable."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash whose counts locate the last row of a sample.
PREFIX_DIGITS = 4
#: Groups whose limits are broadcast; with more of them they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def _hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_sample(df: DataFrame, key: str, k: int, by=(), seed: int = 42, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Exactly the ``k`` rows of each group (all, if it has fewer) with the smallest md5 of (seed, key).

    That is a uniform sample of the rows, as ``key`` is unique, and does not depend on how they are partitioned. It is
    mergeable: the sample of several days is the sample of the union of their samples, so nothing is read twice.

    No task ranks a whole group: counts of the hashes' first 16 bits (added up map-side) tell the one prefix in
    which a group's k-th row lies, rows beyond it are dropped where they are, and only the k rows and the rest of that
    prefix are ranked. Nulls in ``by`` form a group. Pass a stored table, it is read twice.
    """
    by = list(by)
    names = df.columns
    groups = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_by0")]
    group = [f"_by{i}" for i in range(len(groups))]
    hashed = df.select("*", *groups, _hash(F.col(key), seed).alias("_hash")).withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    counted = hashed.groupBy(*group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    up = F.sum("_n").over(Window.partitionBy(*group).orderBy("_prefix"))
    limits = counted.withColumn("_up", up).groupBy(*[F.col(c).alias(f"{c}_") for c in group]).agg(
        F.min(F.when(F.col("_up") >= k, F.col("_prefix"))).alias("_limit"))
    few = limits.limit(broadcast_groups + 1).count() <= broadcast_groups
    match = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group]
    near = hashed.join(F.broadcast(limits) if few else limits, match).filter(F.col("_limit").isNull() | (F.col("_prefix") <= F.col("_limit")))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_hash", key))
    return near.withColumn("_place", place).filter(F.col("_place") <= k).select(*names)
