"""Where intermediate tables and stream checkpoints live."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting, such as a test's, gets a temporary folder of its own: on a cluster the
    executors could not see it, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tamhis-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows_per_file: int = 0, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For results that several later steps scan: the steps then read a few columns of a parquet table
    instead of running the text rules again, and a lost executor costs one re-read. Tables of few large rows
    can be cut in files of so many rows, by which later steps divide their work, and stored without compression (``none``),
    whose codecs keep buffers of the largest value outside the heap.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by ``written``, once nothing reads it any more; other tables are left alone."""
    base, jvm = shared_dir(df.sparkSession).rstrip("/"), df.sparkSession._jvm
    folders = {name.rpartition("/")[0] for name in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        parent = jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        if path.getParent() == fs.makeQualified(parent) or path.getParent().toUri().getPath() == parent.toUri().getPath():
            fs.delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold within it."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Rows go to Python in batches of at most so many bytes, within ``small_buffers``.
BATCH_BYTES = 2 << 20


def small_buffers(spark: SparkSession):
    """Within it, rows of long texts and vectors take little memory on their way to Python and from parquet files.

    The default size of a batch is a number of rows; a batch lies in memory several times, for every task at once. Vectored
    reads keep buffers of the largest value outside the heap, one for each thread that ever read.
    """
    return settings(spark, {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "parquet.hadoop.vectored.io.enabled": "false"})


def shuffles_released(spark: SparkSession):
    """Within it, the shuffle files of a query are deleted as soon as the query ends, not when the driver gets around to it.

    For steps that each write a table with ``written``: none of them reads another one's shuffle files.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
