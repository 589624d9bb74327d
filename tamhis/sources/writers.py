"""Sinks."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tamhis.operators.cells import build_cells
from tamhis.operators.requests import report_lines
from tamhis.schemas import INDEX, INSTRUCTION


def write_instructions(df: DataFrame, path: str, order_by=None) -> int:
    """Overwrite ``path`` with JSON lines in UTF-8, fields in the order of the schema.

    With ``order_by`` (columns of ``df``, such as the row id) the records follow each other in that order through the files
    by name, range-partitioned; a reader that numbers rows in the order of files gets them back so. Returns the number of
    records, counted while writing.
    """
    written = Observation()
    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    (
        df.select(*INSTRUCTION.names)
        .observe(written, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite").option("ignoreNullFields", False).json(path)
    )
    return written.get["n"]


def write_index(df: DataFrame, path: str, cells: bool = True) -> None:
    """Overwrite ``path`` with the rows of an index, and its folder ``_cells`` with their vectors dealt to cells.

    ``readers.read_index`` reads the rows, ``readers.read_cells`` the cells, which spare every search the dealing.
    """
    df.select(*[F.col(f.name).cast(f.dataType) for f in INDEX]).write.mode("overwrite").parquet(path)
    if cells:
        made = build_cells(df.sparkSession.read.schema(INDEX).parquet(path))
        made.write(f"{path}/_cells")
        made.release()


def write_training(df: DataFrame, path: str) -> None:
    """One folder per split, so that a trainer reads only its part."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_report(df: DataFrame, path: str, order_by, question: str = "question", answer: str = "answer") -> None:
    """Text report with two lines per question, in the order of ``order_by`` through the files (range-partitioned)."""
    lines = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    lines.select(report_lines(question, answer).alias("value")).write.mode("overwrite").text(path)
