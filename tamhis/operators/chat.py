"""Chat text from turn tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamhis.functions.chat import ASSISTANT_TURN, turn

#: Turn numbers of a range: what the numbering of turns sorts at a time.
RANGE = 4096


def render_conversations(turns: DataFrame, generation_prompt: bool = True,
                         turns_per_row: int | None = None) -> DataFrame:
    """Chat text per conversation from (conv_id, turn, role, text): (conv_id, part, chat).

    (conv_id, turn) must be unique. By default a conversation is one row (part 0), whatever its size. With
    ``turns_per_row`` a row holds that many of its turns, the last one what is left, and the parts concatenate to the
    whole text; ask for it if a conversation may be too large for a row. The generation prompt ends the last part.
    """
    turns = turns.select("conv_id", "turn", turn(F.col("role"), F.col("text")).alias("t"))
    if turns_per_row is None:
        return turns.groupBy("conv_id").agg(_joined().alias("chat")).select(
            "conv_id", F.lit(0).cast("long").alias("part"), _ended(F.col("chat"), F.lit(generation_prompt)).alias("chat"))
    if turns_per_row < 1:
        raise ValueError("turns_per_row must be at least 1")
    parts = _numbered(turns).withColumn("part", F.floor(F.col("before") / turns_per_row)).groupBy("conv_id", "part").agg(
        _joined().alias("chat"), F.max("total").alias("total"))
    last = F.col("part") == F.floor((F.col("total") - 1) / turns_per_row)
    return parts.select("conv_id", "part", _ended(F.col("chat"), last & F.lit(generation_prompt)).alias("chat"))


def _joined() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "t")))
    return F.array_join(F.transform(ordered, lambda x: F.concat(x["t"], F.lit("\n"))), "")


def _ended(chat: Column, last: Column) -> Column:
    return F.when(last, F.concat(chat, F.lit(ASSISTANT_TURN))).otherwise(chat)


def _numbered(turns: DataFrame) -> DataFrame:
    """Add ``before`` (turns of the conversation before this one) and ``total``.

    Turns are counted per range of turn numbers, the counts are summed up, and only within a range are turns
    ranked, so no task sorts a whole conversation.
    """
    ranged = turns.withColumn("range", F.floor(F.col("turn") / RANGE))
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.sum("n").over(conversation).alias("total"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn"))
    return ranged.withColumn("rank", rank).join(counts, ["conv_id", "range"]).withColumn(
        "before", F.col("offset") + F.col("rank") - 1)
