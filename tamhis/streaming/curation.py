"""Incremental curation of newly landed rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.operators.curation import first_per_key
from tamhis.plans.curate import as_records, valid_pairs
from tamhis.profiles import ARABIC, LanguageProfile
from tamhis.streaming.sink import BatchTable, run_available

CURATED = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])
#: 128-bit digests of the stored questions.
KEYS = T.StructType([T.StructField("key", T.BinaryType())])

#: Batches of up to so many different questions probe the stored digests for each.
PROBES = 1024

BROADCAST_BYTES = 32 * 1024 * 1024
KEY_BYTES = 64  # generous size of a 16-byte key in a hash table


def key_table(spark, path: str) -> BatchTable:
    return BatchTable(spark, f"{path.rstrip('/')}-keys", KEYS, "key")


def curate_stream(raw: DataFrame, path: str, checkpoint: str, profile: LanguageProfile = ARABIC) -> BatchTable:
    """Curate a stream of raw rows into a table of instruction records.

    Gates run on the stream. Per batch the first row of each question survives unless an
    earlier batch already has the question; with files that arrive in row order the table equals the
    batch result. Questions are also stored as 128-bit digests in a table of their own, sorted, a file per batch or
    per eight million. A batch of few questions probes it: only the row groups whose range and Bloom filter admit one of its
    digests are read. A larger one reads at most 16 bytes per stored row: the stored keys are first
    reduced to those of the batch; a batch counted to be small is broadcast, and the stored keys are then
    scanned without a shuffle. ``compact`` of the returned table and of ``key_table`` merges the batches' files.
    """
    table, keys = BatchTable(raw.sparkSession, path, CURATED), key_table(raw.sparkSession, path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("key", F.unhex(F.md5("q"))).persist()
        try:
            rows = batch.count()
            small = F.broadcast if rows * KEY_BYTES <= BROADCAST_BYTES else (lambda df: df)
            asked = batch.select("key").distinct()
            some = [r["key"] for r in asked.limit(PROBES + 1).collect()]
            if len(some) <= PROBES:
                seen = small(keys.probe(batch_id, some))
            else:
                seen = small(keys.earlier(batch_id).join(small(asked), "key", "left_semi"))
            first = first_per_key(batch, "q", "row_id").join(seen, "key", "left_anti").persist()
            try:
                table.write(as_records(first, profile), batch_id)
                keys.write(first, batch_id, rows)
            finally:
                first.unpersist()
        finally:
            batch.unpersist()

    # lists up to this long are handed to the reader value by value
    raw.sparkSession.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", PROBES)
    run_available(valid_pairs(raw, profile), handle, checkpoint)
    return table
