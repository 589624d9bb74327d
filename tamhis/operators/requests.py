"""Request validation, answer records, answer comparison and reports."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis import profiles as P
from tamhis.functions.text import is_blank, strip

# Request bounds and defaults.
MESSAGE_CHARS = (2, 2000)
MAX_TOKENS, MAX_TOKENS_DEFAULT = (64, 1024), 512
TEMPERATURE, TEMPERATURE_DEFAULT = (0.1, 1.5), 0.3


def validate_requests(df: DataFrame) -> DataFrame:
    """Fill defaults and add ``status`` (200, 400, 422) and ``error``; also works on a stream."""
    def broken(ok: Column, name: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), name)

    bad_fields = F.concat_ws(
        ",",
        broken(F.length("message").between(*MESSAGE_CHARS), "message"),
        broken(F.col("max_tokens").between(*MAX_TOKENS), "max_tokens"),
        broken(F.col("temperature").between(*TEMPERATURE), "temperature"),
    )
    return (
        df.withColumns({
            "max_tokens": F.coalesce(F.col("max_tokens"), F.lit(MAX_TOKENS_DEFAULT)),
            "temperature": F.coalesce(F.col("temperature"), F.lit(TEMPERATURE_DEFAULT)),
        })
        .withColumn("_bad", bad_fields)
        .withColumn(
            "status",
            F.when(F.col("_bad") != "", 422).when(is_blank(F.col("message")), 400).otherwise(200).cast("long"),
        )
        .withColumn(
            "error", F.when(F.col("status") == 422, F.col("_bad")).when(F.col("status") == 400, P.EMPTY_MESSAGE)
        )
        .drop("_bad")
    )


def response_records(df: DataFrame, answer: str, elapsed: str, device: str, rag: bool) -> DataFrame:
    """Replace the answer columns by the response record."""
    return df.withColumns({
        "response": strip(F.col(answer)),
        "elapsed_seconds": F.round(elapsed, 2),
        "device": F.lit(device),
        "rag": F.lit(rag),
        "disclaimer": F.lit(P.DISCLAIMER),
    }).drop(*({answer, elapsed} - {"response", "elapsed_seconds"}))


def panel(spark: SparkSession, questions) -> DataFrame:
    """A fixed list of test questions as (question_id, question), numbered from 1."""
    return spark.createDataFrame(list(enumerate(questions, 1)), "question_id long, question string")


def answer_panel(asked: DataFrame, answers: DataFrame, keys=("question_id",)) -> DataFrame:
    """Every question with its answer, ``''`` where there is none: a left equi-join on the question's key."""
    return asked.join(answers, list(keys), "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def compare_answers(answers: DataFrame, models, keys=("question_id",)) -> DataFrame:
    """One row per question, one column per model; (keys, model) must be unique."""
    return answers.groupBy(*keys).pivot("model", list(models)).agg(F.max("answer"))


def report_lines(question: str = "question", answer: str = "answer") -> Column:
    """Two report lines, question then answer."""
    return F.concat(
        F.lit(P.REPORT_QUESTION), F.col(question), F.lit("\n"),
        F.lit(P.REPORT_ANSWER), F.col(answer),
    )
