"""Retrieval documents, index and prompts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis.functions import chat
from tamhis.operators.cells import Cells, comparable
from tamhis.operators.nearest import nearest
from tamhis.workspace import small_buffers, written


def documents(records: DataFrame, doc_id: str = "row_id") -> DataFrame:
    """(doc_id, doc_text) of the records with a non-blank question and answer."""
    return records.select(
        F.col(doc_id).alias("doc_id"),
        chat.document_text(F.col("instruction"), F.col("input"), F.col("output")).alias("doc_text"),
    ).filter("doc_text is not null")


def build_index(records: DataFrame, encoder, doc_id: str = "row_id") -> DataFrame:
    """(doc_id, doc_text, embedding), stored in the shared folder: searches read it in several passes, and each
    document should be encoded once. ``write_index`` keeps it elsewhere."""
    with small_buffers(records.sparkSession):
        return written(encoder.encode(documents(records, doc_id), "doc_text").select("doc_id", "doc_text", "embedding"), "index")


def retrieve_context(index: DataFrame, queries: DataFrame, k: int = 2, cells: Cells | None = None) -> DataFrame:
    """(query_id, context): the k nearest document texts, nearest first, a blank line between them.

    ``index`` must be a stored table: its vectors and its texts are read in separate passes. With its ``cells``, as
    ``write_index`` stores them, its vectors are not dealt again.
    """
    hits = nearest(index, queries, k, cells=cells)
    texts = hits.join(index.select("doc_id", "doc_text"), "doc_id")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "doc_text")))  # k entries
    return texts.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda x: x["doc_text"]), "\n\n").alias("context")
    )


def rag_prompts(requests: DataFrame, index: DataFrame, k: int = 2, cells: Cells | None = None) -> DataFrame:
    """Add ``prompt`` to requests (message, embedding ..).

    Every request gets the context of its own vector; equal vectors are looked up once. The requests are stored
    first, so that each is encoded once. A request without a vector of finite numbers gets the plain prompt; one
    for which the index holds no vector of the same length gets an empty reference part.
    """
    vector, key = F.col("embedding"), "_vector"
    keyed = F.when(comparable(vector), F.concat_ws(
        ":", F.size(vector), F.xxhash64(vector), F.xxhash64(F.lit(1), vector)))
    with small_buffers(requests.sparkSession):
        requests = written(requests.withColumn(key, keyed), "requests")
    queries = requests.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("query_id")).agg(
        F.any_value("embedding").alias("embedding"))  # equal up to the digest
    contexts = retrieve_context(index, queries, k, cells).withColumnRenamed("query_id", key)
    plain = chat.render_messages(chat.prompt_messages(F.col("message")))
    found = chat.render_messages(chat.prompt_messages(F.col("message"), F.coalesce("context", F.lit(""))))
    return (
        requests.drop("embedding").join(contexts, key, "left")
        .withColumn("prompt", F.when(F.col(key).isNull(), plain).otherwise(found))
        .drop("context", key)
    )


def plain_prompts(requests: DataFrame) -> DataFrame:
    """Add ``prompt`` without retrieval; no index is read."""
    return requests.withColumn("prompt", chat.render_messages(chat.prompt_messages(F.col("message"))))
