"""Row numbers in the order of files and of the rows in them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamhis.workspace import written

#: Splits whose table, some 40 bytes each, is broadcast; a longer one is joined by a shuffle.
BROADCAST_SPLITS = 1 << 20


def in_file_order(scan: DataFrame, out: str = "row_id", fmt: str = "json", broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """``scan`` with ``out``: 0, 1, 2 .. in the order of the paths of its files, then of the rows in a file.

    ``scan`` must come straight from a reader of files, of any number and size, that drops no malformed rows. Spark deals
    files to tasks by their size, so the order of a scan's rows says nothing about them. But every row knows its
    file, the place where its split begins (hidden columns of the scan) and its place in the split. A scan of these
    alone counts the rows of every split, the counts are summed up over the splits, and the sums are joined to
    the rows: the data are neither sorted nor moved. The numbers themselves are lazy, the counting is not.

    In parquet the reader knows the place in the file. In other formats it follows from the running number in the task,
    so both scans must cut and deal the files alike, which they do unless the files or the number of cores change between
    them. A row outside of what was counted for its split fails the job, so that no wrong number is given.
    """
    parquet = fmt == "parquet"
    start = F.lit(0).cast("long") if parquet else F.col("_metadata.file_block_start")
    at = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    path = F.col("_metadata.file_path")
    names = scan.columns
    counted = (
        scan.select(path.alias("path"), start.alias("start"), at.alias("at"))
        .groupBy("path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split, some 8,000 a TB
    splits = written(counted.select(
        F.xxhash64("path").alias("_file"), F.col("start").alias("_start"), "n",
        (F.lit(0).cast("long") if parquet else F.col("first")).alias("first"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "splits")
    size, files = splits.agg(F.count(F.lit(1)), F.count_distinct("_file", "_start")).first()
    if size != files:
        raise RuntimeError("two files have the same 64-bit hash of their paths")
    placed = scan.select("*", F.xxhash64(path).alias("_file"), start.alias("_start"), at.alias("_at"))
    known = placed.join(F.broadcast(splits) if size <= broadcast_splits else splits, ["_file", "_start"], "left")
    place = F.col("_at") - F.col("first")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place).otherwise(
        F.raise_error(F.lit("the files were dealt differently by the scan that counted their rows")).cast("long"))
    return known.select(*names, number.alias(out))
