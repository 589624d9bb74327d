"""Requests arriving as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.operators.requests import validate_requests
from tamhis.operators.cells import Cells, build_cells
from tamhis.plans.retrieval import plain_prompts, rag_prompts
from tamhis.streaming.sink import BatchTable, run_available

PROMPTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("status", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("prompt", T.StringType()),
])


def prompt_stream(requests: DataFrame, path: str, checkpoint: str, attach=None, index: DataFrame | None = None,
                  k: int = 2, cells: Cells | None = None) -> BatchTable:
    """Validate a stream of requests and store their prompts.

    Refused requests are stored with their status and no prompt. With an ``index``, ``attach`` maps
    the accepted requests of a batch to their columns with ``embedding`` added, and the prompt
    holds the k nearest documents; a request without a vector gets the plain prompt. Without an index none is read. The
    index is dealt to cells once for all batches, unless its stored ``cells`` are given.
    """
    own = index is not None and cells is None
    cells = build_cells(index) if own else cells
    table = BatchTable(requests.sparkSession, path, PROMPTS)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            accepted = batch.filter("status = 200")
            prompts = plain_prompts(accepted) if index is None else rag_prompts(attach(accepted), index, k, cells)
            refused = batch.filter("status <> 200").withColumn("prompt", F.lit(None).cast("string"))
            table.write(prompts.select(*PROMPTS.names).unionByName(refused.select(*PROMPTS.names)), batch_id)
        finally:
            batch.unpersist()

    try:
        run_available(validate_requests(requests), handle, checkpoint)
    finally:
        if own:
            cells.release()
    return table
