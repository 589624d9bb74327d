"""The supplied tables in the shapes the package works on. Every row of a table is used."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamhis.functions import text as X
from tamhis.operators.requests import answer_panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_from_documents(documents: DataFrame, *extra: Column) -> DataFrame:
    """Raw question/answer rows: the first line is the question, the rest the answer.

    French and Spanish rows fill the q_body/a_body pair and end in a signature, the others fill
    question/reply and end in a rating line. All rows have body counts. A text of one line has no answer; every
    53rd row has no category.
    """
    body = F.col("lang").isin("fr", "es")
    first = F.substring_index("text", "\n", 1)
    split = documents.withColumn("first", first).withColumn(
        "rest", F.when(F.col("text").contains("\n"), F.expr("substr(text, length(first) + 2)"))
    )
    signed = F.concat("rest", F.lit("\nDr. "), "source")
    rated = F.concat("rest", F.lit("\n5\n "), "source")
    return split.select(
        F.col("doc_id").alias("row_id"),
        F.when(body, F.col("first")).alias("q_body"),
        F.when(body, signed).alias("a_body"),
        F.when(F.col("doc_id") % 53 != 0, F.col("source")).alias("category"),
        X.word_count(F.col("first")).cast("double").alias("q_body_count"),
        X.word_count(F.when(body, signed).otherwise(rated)).cast("double").alias("a_body_count"),
        F.when(~body, F.col("first")).alias("question"),
        F.when(~body, rated).alias("reply"),
        *extra,
    )


def raw_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_documents(table(spark, sf_dir, "documents"))


def raw_qa_with_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows plus instruction/output: German rows have an instruction but an empty output."""
    documents, german = table(spark, sf_dir, "documents"), F.col("lang") == "de"
    return raw_from_documents(
        documents,
        F.when(german, F.concat(F.lit("Q: "), F.col("source"))).alias("instruction"),
        F.when(german, F.lit("")).alias("output"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records: instruction = first line, input = language, output = the whole text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.substring_index("text", "\n", 1).alias("instruction"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("input"),
        F.col("text").alias("output"),
    )


def noisy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with an address, a link, a number line and a signature added."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit("see http://x.example/"), F.col("doc_id").cast("string"), F.lit(" or www.x.example\n"),
        F.col("text"), F.lit(" ask me@"), F.col("source"), F.lit(".org now"),
        F.lit("\n \nDr. "), F.col("lang"), F.lit("\n"), F.col("n_chars").cast("string"), F.lit("\n end"),
    ).alias("text"))


def requests_from_turns(turns: DataFrame) -> DataFrame:
    """User turns as requests; some bounds are broken, some options missing, some messages blank."""
    tokens = (F.col("conv_id") * 37 + F.col("turn") * 101) % 24 * 50
    return turns.filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.when((F.col("conv_id") + F.col("turn")) % 10 == 3, F.lit(" \n  ")).otherwise(F.col("text")).alias("message"),
        F.nullif(tokens, F.lit(0)).cast("long").alias("max_tokens"),
        F.when(F.col("turn") > 0, ((F.col("conv_id") + F.col("turn")) % 19).cast("double") / 10.0).alias("temperature"),
        F.col("conv_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_turns(table(spark, sf_dir, "conversations"))


def panel_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): every user turn with the assistant turn after it, if there is one."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return answer_panel(asked, given, ["conv_id", "turn"])


def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): user turns with the assistant turn after them."""
    return panel_turns(spark, sf_dir).filter("answer <> ''")


def answers_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, model, answer): two answers per question, from two stand-in models."""
    return (
        answered_turns(spark, sf_dir)
        .select("conv_id", "turn", F.concat(F.lit("In short: "), "answer").alias("base"), F.col("answer").alias("tuned"))
        .unpivot(["conv_id", "turn"], ["base", "tuned"], "model", "answer")
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
    return texts.join(vectors, "doc_id")


def with_query_vectors(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests get the vector numbered by their conversation and turn, if there is one: requests of a conversation
    share their ``query_id`` but not their vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")
    turn = F.substring_index("request_id", "-", -1).cast("long")
    asked = df.withColumns({"query_id": F.col("conv_id"), "vector_id": F.col("conv_id") * 3 + turn})
    return asked.join(vectors, "vector_id", "left").drop("vector_id")


def spoiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding): every 97th vector is spoiled in one of four ways."""
    v, way = F.col("embedding"), F.floor(F.col("vec_id") / 97) % 4
    middle = F.slice(v, 2, F.size(v) - 2)
    first = F.array(v[0])

    def ending(x):
        return F.concat(first, middle, F.array(F.lit(x).cast("float")))

    spoiled = (F.when(way == 0, ending(float("nan"))).when(way == 1, ending(float("inf"))).when(way == 2, ending(None))
               .otherwise(F.concat(first, middle)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 97 == 0, spoiled).otherwise(v).alias("embedding"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label as (query_id, embedding)."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.col("label").cast("long").alias("query_id"))
        .agg(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("m"))
        .select("query_id", vector_to_array("m").alias("embedding"))
    )
