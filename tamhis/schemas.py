"""Schemas of the tables the package reads and writes."""

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

#: Raw question/answer rows. A row fills one of the pairs question/reply or q_body/a_body.
RAW_QA = T.StructType([
    T.StructField("q_body", STRING),
    T.StructField("a_body", STRING),
    T.StructField("category", STRING),
    T.StructField("q_body_count", DOUBLE),
    T.StructField("a_body_count", DOUBLE),
    T.StructField("question", STRING),
    T.StructField("reply", STRING),
])

INSTRUCTION = T.StructType([
    T.StructField("instruction", STRING),
    T.StructField("input", STRING),
    T.StructField("output", STRING),
])

TRAINING_TEXT = T.StructType([T.StructField("text", STRING)])

REQUEST = T.StructType([
    T.StructField("request_id", STRING),
    T.StructField("message", STRING),
    T.StructField("max_tokens", LONG),
    T.StructField("temperature", DOUBLE),
])

INDEX = T.StructType([
    T.StructField("doc_id", LONG),
    T.StructField("doc_text", STRING),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

#: Fields tried in this order for the question and for the answer; the two sides are independent.
QUESTION_FIELDS = ("instruction", "question", "q_body")
ANSWER_FIELDS = ("output", "reply", "a_body")
