"""A parquet table written batch by batch, safe to re-run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Rows of a file, and bytes of a row group, of a table that is sorted to be probed.
FILE_ROWS, GROUP_BYTES = 8_000_000, 1 << 20


class BatchTable:
    """Parquet table with one ``batch_id`` folder per micro-batch.

    A batch that runs again after a failure overwrites its own folder and, by reading only
    ``earlier`` batches, computes the same rows: each batch takes effect once. ``compact`` merges old batches into one
    folder, ``upto-`` its last batch, which takes the place of all batches up to it as soon as it is complete.

    A table ``sorted_by`` a column is made to be probed for single values: each folder has one file per eight million rows,
    range-partitioned and sorted, in small row groups with statistics and Bloom filters of the column, so that
    ``probe`` reads only the row groups that can hold a value.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sorted_by: str | None = None):
        self.spark, self.path, self.schema, self.sorted_by = spark, path, schema, sorted_by

    def write(self, df: DataFrame, batch_id: int, rows: int | None = None) -> None:
        """Store a batch; ``rows``, a bound of its size, decides the number of files of a sorted table."""
        self._write(df, str(batch_id), rows)

    def probe(self, batch_id: int, values: list[bytes]) -> DataFrame:
        """The rows of earlier batches whose sorted column is one of some hundred values."""
        wanted = ", ".join(f"X'{bytes(v).hex()}'" for v in values)
        return self.earlier(batch_id).filter(f"{self.sorted_by} IN ({wanted})" if values else "false")

    def read(self) -> DataFrame:
        return self._stored(None)

    def earlier(self, batch_id: int) -> DataFrame:
        return self._stored(batch_id)

    def batches(self) -> list[int]:
        """Numbers of the batches in folders of their own."""
        return sorted(self._folders()[1])

    def compact(self) -> None:
        """Merge all batches but the newest, which may have to run again; call it when no stream writes."""
        upto, batches = self._folders()
        old = sorted(batches)[:-1]
        if len(old) + bool(upto) < 2:
            return
        stored = self._stored(old[-1] + 1)
        self._write(stored, f"upto-{old[-1]}", stored.count() if self.sorted_by else None)
        for b in old:
            self._delete(str(b))
        for u in upto:
            self._delete(f"upto-{u}")

    def _write(self, df: DataFrame, folder: str, rows: int | None) -> None:
        df, options = df.select(*self.schema.names), {}
        if self.sorted_by:
            files = max(1, -(-(FILE_ROWS if rows is None else rows) // FILE_ROWS))
            # shuffled even into one file: a task that only gathers partitions would read all columns of a stored batch
            df = (df.repartitionByRange(files, self.sorted_by) if files > 1 else df.repartition(1)).sortWithinPartitions(self.sorted_by)
            options = {"parquet.block.size": GROUP_BYTES, f"parquet.bloom.filter.enabled#{self.sorted_by}": "true",
                       f"parquet.bloom.filter.expected.ndv#{self.sorted_by}": GROUP_BYTES // 16}
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/batch_id={folder}")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, folder: str) -> None:
        path, fs = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"batch_id={folder}"), True)

    def _folders(self) -> tuple[list[int], list[int]]:
        """Numbers of the complete ``upto`` folders, and of the batches after the last of them."""
        path, fs = self._fs()
        if not fs.exists(path):
            return [], []
        folders = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch_id=")]
        done = [p.getName()[9:] for p in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        upto = sorted(int(n[5:]) for n in done if n.startswith("upto-"))
        return upto, sorted(int(n) for n in done if n.isdigit() and (not upto or int(n) > upto[-1]))

    def _stored(self, before: int | None) -> DataFrame:
        upto, batches = self._folders()
        folders = [f"upto-{u}" for u in upto[-1:]] + [str(b) for b in batches if before is None or b < before]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("batch_id", T.StringType())])
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/batch_id={f}" for f in folders]).select(*self.schema.names)


def run_available(stream: DataFrame, handle, checkpoint: str) -> None:
    """Process everything that has arrived, in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
