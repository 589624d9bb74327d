"""Scans. All schemas are declared; nothing is inferred."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.functions.text import is_blank
from tamhis.operators.cells import Cells
from tamhis.schemas import INDEX, INSTRUCTION, RAW_QA, TRAINING_TEXT
from tamhis.sources.order import in_file_order
from tamhis.workspace import release, written

_CORRUPT = "_corrupt_record"


def read_raw_qa(spark: SparkSession, path, fmt: str = "parquet", row_id: str | None = None,
                multi_line: bool = False, extra: T.StructType | None = None) -> DataFrame:
    """Raw question/answer rows plus ``row_id``, which fixes the order for first-wins rules.

    Name the source's own key in ``row_id`` if there is one. Otherwise rows are numbered from 0 in the order of
    the files' paths and of the rows in them, which takes a scan that counts them (``order.in_file_order``). ``extra`` adds fields such as
    instruction/output. ``multi_line`` reads a JSON file that is one array, or a CSV file whose quoted fields hold line
    breaks; such files are read by one task each, so they should be many and small.
    """
    schema = T.StructType([*RAW_QA.fields, *(extra.fields if extra else [])])
    if row_id is not None:
        schema = T.StructType([*schema.fields, T.StructField(row_id, T.LongType())])
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "json":
        reader = reader.option("multiLine", multi_line)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"')
    df = reader.load(path)
    return df.withColumn("row_id", F.col(row_id)) if row_id else in_file_order(df, "row_id", fmt)


def read_jsonl_strict(spark: SparkSession, path, schema: T.StructType = INSTRUCTION) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that is not exactly one JSON object fails the job."""
    parsed = _parsed(spark, path, schema)
    checked = F.when(F.col("record").isNull(), F.raise_error(
        F.concat(F.lit("not one JSON object: "), F.substring("line", 1, 200))).cast(schema)).otherwise(F.col("record"))
    return parsed.select(checked.alias("record")).select("record.*")


def read_jsonl_tolerant(spark: SparkSession, path, schema: T.StructType = INSTRUCTION, seen: Observation | None = None) -> DataFrame:
    """JSON lines; blank lines and lines that are not exactly one JSON object are skipped, missing text fields
    become ``''``.

    ``seen`` counts in the same pass: once an action has run, ``seen.get`` has the numbers of ``lines`` that are not blank
    and of those ``rejected``.
    """
    parsed = _parsed(spark, path, schema)
    if seen is not None:
        parsed = parsed.observe(
            seen, F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("record").isNull(), 1)).alias("rejected"))
    return parsed.filter("record is not null").select("record.*").na.fill("")


class TooManyRejects(ValueError):
    """A source with a larger share of unreadable lines than allowed."""


def read_jsonl_within(spark: SparkSession, path, max_share: float, schema: T.StructType = INSTRUCTION) -> tuple[DataFrame, dict]:
    """(records, counts) of a tolerant reading, or ``TooManyRejects`` if over ``max_share`` of the lines are rejected.

    The lines are parsed once: the records are stored in the shared folder while the counts (``lines``, ``rejected``) are
    taken, and deleted again if there are too many rejects, so nothing downstream sees a part of a broken source.
    """
    seen = Observation()
    records = written(read_jsonl_tolerant(spark, path, schema, seen), "records")
    counts = dict(seen.get)
    if counts["rejected"] > max_share * counts["lines"]:
        release(records)
        raise TooManyRejects(f"{counts['rejected']} of {counts['lines']} lines are not one JSON object each: {path}")
    return records, counts


def rejected_lines(spark: SparkSession, path, schema: T.StructType = INSTRUCTION) -> DataFrame:
    """The lines ``read_jsonl_tolerant`` skips, as (line); blank ones are not listed."""
    return _parsed(spark, path, schema).filter("record is null").select("line")


def _parsed(spark, path, schema):
    """(line, record): every line that is not blank (Unicode white space), with a null record unless the line is one
    object. A line is read as the only element of an array, so that nothing may stand before or after the object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}
    full = T.ArrayType(T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]))
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    records = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), full, options)
    one = F.col("records")[0]
    whole = (F.size("records") == 1) & one[_CORRUPT].isNull() & F.ltrim(F.col("value")).startswith("{")
    kept = F.struct(*[one[f.name].alias(f.name) for f in schema])
    return lines.withColumn("records", records).select(
        F.col("value").alias("line"), F.when(F.coalesce(whole, F.lit(False)), kept).alias("record"))


def read_training_csv(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """CSV with a ``text`` column; quoted fields may hold doubled quotes and, with ``multi_line``, line breaks.

    With it a file is read by one task, so files should be many and small.
    """
    return (
        spark.read.schema(TRAINING_TEXT)
        .options(header=True, multiLine=multi_line, quote='"', escape='"')
        .csv(path)
    )


def read_index(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def read_cells(spark: SparkSession, path) -> Cells:
    """The cells of a stored index, for ``nearest`` and ``rag_prompts``."""
    return Cells.read(spark, f"{path}/_cells")


def head(df: DataFrame, n: int = 5, order_by: str = "row_id") -> DataFrame:
    """The first ``n`` rows; planned as a top-n, not as a sort."""
    return df.orderBy(order_by).limit(n)
