"""Instruction records to training texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.functions import chat
from tamhis.operators.split import split_exact


def chatml_records(records: DataFrame) -> DataFrame:
    """Add ``text`` in chat format."""
    return records.withColumn("text", chat.chatml(F.col("instruction"), F.col("input"), F.col("output")))


def template_records(records: DataFrame) -> DataFrame:
    """Add ``text`` from the single prompt template; used without a split."""
    return records.withColumn("text", chat.template_prompt(F.col("instruction"), F.col("output")))


def training_set(records: DataFrame, key: str = "row_id", test_share: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, text, split). Pass a stored table: the split scans its key column three times."""
    return split_exact(chatml_records(records).select(key, "text"), key, test_share, seed)


def split_sizes(training: DataFrame) -> DataFrame:
    """(split, n): rows of each part."""
    return training.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
