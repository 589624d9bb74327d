"""Field selection, gates and first-wins de-duplication of raw question/answer rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamhis.functions import text as X
from tamhis.profiles import ARABIC, LanguageProfile
from tamhis.schemas import ANSWER_FIELDS, QUESTION_FIELDS

MIN_ANSWER_WORDS = 15
MIN_QUESTION_WORDS = 3


def first_non_empty(df: DataFrame, fields) -> Column:
    """First field that is neither null nor ``''``; fields the table lacks are skipped."""
    present = [F.nullif(F.col(f), F.lit("")) for f in fields if f in df.columns]
    return F.coalesce(*present, F.lit(""))


def with_qa(df: DataFrame) -> DataFrame:
    """Add ``q`` and ``a``, each from the first non-empty of its fields."""
    return df.withColumns({"q": first_non_empty(df, QUESTION_FIELDS), "a": first_non_empty(df, ANSWER_FIELDS)})


def long_enough(q: Column, a: Column) -> Column:
    return X.has_words(a, MIN_ANSWER_WORDS) & X.has_words(q, MIN_QUESTION_WORDS)


def on_topic(q: Column, profile: LanguageProfile = ARABIC) -> Column:
    """Some general keyword and no personal one in the normalised question."""
    return X.has_any(X.normalize(q, profile), profile.general, unless=profile.personal)


def is_valid_pair(q: Column, a: Column, profile: LanguageProfile = ARABIC) -> Column:
    return long_enough(q, a) & on_topic(q, profile)


def gate_flags(df: DataFrame, profile: LanguageProfile = ARABIC) -> DataFrame:
    """Add one boolean per gate; ``q`` and ``a`` must exist."""
    q, a = F.col("q"), F.col("a")
    return (
        df.withColumn("normal_q", X.normalize(q, profile))
        .withColumns({
            "non_empty": (q != "") & (a != ""),
            "long_enough": long_enough(q, a),
            "general": X.has_any(F.col("normal_q"), profile.general),
            "personal": X.has_any(F.col("normal_q"), profile.personal),
        })
        .drop("normal_q")
    )


def reject_reason() -> Column:
    """First gate that refused the row (over ``gate_flags``), null for a kept row."""
    return (
        F.when(~F.col("non_empty"), "empty")
        .when(~F.col("long_enough"), "short")
        .when(~F.col("general"), "not_general")
        .when(F.col("personal"), "personal")
    )


def cleaned(df: DataFrame, columns, profile: LanguageProfile = ARABIC) -> DataFrame:
    """``df`` with the named text columns cleaned.

    Same result as ``functions.text.clean``; each rule runs only on texts that hold its trigger
    character. One projection per rule, so that the guards test an attribute instead of repeating
    the rules before it.
    """
    def step(frame, needles, rule):
        return frame.withColumns({
            c: F.when(reduce(Column.__or__, [F.col(c).contains(n) for n in needles]), rule(F.col(c)))
            .otherwise(F.col(c))
            for c in columns
        })

    df = step(df, ("http", "www"), X.strip_urls)
    df = step(df, ("@",), X.strip_emails)
    df = step(df, ("\n",), X.cut_number_tail)
    df = step(df, ("\n",), lambda c: X.cut_signature(c, profile))
    return df.withColumns({c: X.collapse_spaces(F.col(c)) for c in columns})


def first_per_key(df: DataFrame, key: str, order_by) -> DataFrame:
    """One row per key: the first by ``order_by``.

    The row-number filter plans as a group limit before and after the shuffle, so each map task
    sends one row per key however many copies a key has. The 64-bit hash leads the sort so that
    long texts are compared only on equal hashes; the text itself decides equality.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    first = Window.partitionBy(F.xxhash64(key), key).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def digest(*columns: str) -> Column:
    """128-bit digest of several columns of any simple type; nulls are told apart from ``''``."""
    def part(c):
        s = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.md5(F.concat_ws("|", *[part(c) for c in columns])))
