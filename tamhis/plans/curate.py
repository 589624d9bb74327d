"""Raw rows to instruction records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.operators import curation as C
from tamhis.profiles import ARABIC, LanguageProfile


def valid_pairs(raw: DataFrame, profile: LanguageProfile = ARABIC) -> DataFrame:
    """(row_id, q, a) of the valid pairs, the question cleaned. No shuffle; also works on a stream.

    The gates see the raw texts, so a cleaned text may be short or empty.
    """
    qa = C.with_qa(raw).select("row_id", "q", "a")
    return C.cleaned(qa.filter(C.is_valid_pair(F.col("q"), F.col("a"), profile)), ("q",), profile)


def as_records(pairs: DataFrame, profile: LanguageProfile = ARABIC) -> DataFrame:
    """Clean the answers and project to instruction records. Last, so that only kept answers are cleaned."""
    return (
        C.cleaned(pairs, ("a",), profile)
        .withColumn("input", F.lit(""))
        .withColumnsRenamed({"q": "instruction", "a": "output"})
    )


def curate(raw: DataFrame, profile: LanguageProfile = ARABIC) -> DataFrame:
    """(row_id, instruction, input, output); the first valid row of each cleaned question wins."""
    first = C.first_per_key(valid_pairs(raw, profile), "q", "row_id")
    return as_records(first, profile).select("row_id", "instruction", "input", "output")


def curation_funnel(raw: DataFrame, profile: LanguageProfile = ARABIC) -> DataFrame:
    """Rows left after each step, as one row of counts.

    Distinct questions are counted by digest, so 16 bytes per distinct question are shuffled.
    """
    flags = C.gate_flags(C.with_qa(raw), profile)
    kept = F.col("non_empty") & F.col("long_enough") & F.col("general") & ~F.col("personal")
    flags = flags.withColumn("kept", kept).withColumn("key", F.when(F.col("kept"), F.col("q")))
    flags = C.cleaned(flags.select("non_empty", "long_enough", "general", "personal", "kept", "key"), ("key",), profile)
    return flags.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("non_empty").alias("n_non_empty"),
        F.count_if(F.col("non_empty") & F.col("long_enough")).alias("n_long_enough"),
        F.count_if(F.col("non_empty") & F.col("long_enough") & F.col("general")).alias("n_general"),
        F.count_if("kept").alias("n_not_personal"),
        F.count_distinct(F.unhex(F.md5("key"))).alias("n_unique"),
    )
