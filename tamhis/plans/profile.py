"""Profile of a raw question/answer table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.functions import text as X
from tamhis.operators import counts as N
from tamhis.operators import distributions as D
from tamhis.operators.curation import digest
from tamhis.streaming.sink import BatchTable
from tamhis.workspace import written

#: Display labels of the length columns.
LABELS = {"question_len": "Question", "reply_len": "Answer"}
#: Display names of the numeric columns.
NUMERIC = {
    "question_len": "Q Len", "reply_len": "A Len",
    "question_word_count": "Q Words", "answer_word_count": "A Words",
}


def answered(raw: DataFrame) -> DataFrame:
    """Rows with a reply; the profile is about these."""
    return raw.na.drop(subset=["reply"])


def columns(raw: DataFrame) -> DataFrame:
    """Column profile of all rows, of the body counts where there is a reply, and without them."""
    names = [c for c in raw.columns if c != "row_id"]
    counts = ["q_body_count", "a_body_count"]
    replied = F.col("reply").isNotNull()
    return N.column_profile(raw, {
        "all_rows": (None, names),
        "with_reply": (replied, counts),
        "without_counts": (replied, [c for c in names if c not in counts]),
    })


def lengths(raw: DataFrame, question: str = "question", reply: str = "reply",
            none_as_text: bool = False, keep=()) -> DataFrame:
    """(row_id, category, four measures, the columns ``keep``) of the rows that have a reply.

    ``none_as_text`` counts a missing text as the word 'None' instead of leaving it out.
    """
    rows = raw.na.drop(subset=[reply])
    return rows.select(
        "row_id", "category",
        X.char_count(F.col(question), none_as_text).alias("question_len"),
        X.char_count(F.col(reply), none_as_text).alias("reply_len"),
        X.word_count(F.col(question), none_as_text).alias("question_word_count"),
        X.word_count(F.col(reply), none_as_text).alias("answer_word_count"),
        *keep,
    )


def char_lengths(df: DataFrame, by=()) -> DataFrame:
    """Value counts of the two character lengths, under their labels."""
    return D.value_counts(df, {label: F.col(c) for c, label in LABELS.items()}, by)


def length_unpivot(df: DataFrame) -> DataFrame:
    """One row per text: (row_id, type, char_length)."""
    return (
        df.select("row_id", *[F.col(c).alias(label) for c, label in LABELS.items()])
        .unpivot(["row_id"], list(LABELS.values()), "type", "char_length")
    )


def numeric_frame(df: DataFrame) -> DataFrame:
    """The four measures under their display names."""
    return df.select(*[F.col(c).alias(label) for c, label in NUMERIC.items()])


def numeric_counts(df: DataFrame) -> DataFrame:
    return D.value_counts(df, {label: F.col(c) for c, label in NUMERIC.items()})


def pair_matrix(df: DataFrame, bins: int = 20) -> DataFrame:
    """Off-diagonal cells of the 4 x 4 pair plot as bin counts."""
    frame = numeric_frame(df)
    return D.grid_counts(frame, [(x, y) for x in frame.columns for y in frame.columns if x != y], bins)


def body_counts(raw: DataFrame) -> DataFrame:
    """count, mean, std, quartiles of the body counts and of the word counts among answered rows."""
    measures = answered(raw).select(
        "q_body_count", "a_body_count",
        X.word_count(F.col("question")).alias("question_word_count"),
        X.word_count(F.col("reply")).alias("answer_word_count"),
    )
    return D.describe(D.value_counts(measures, {c: F.col(c) for c in measures.columns}))


def categories(raw: DataFrame) -> DataFrame:
    """Answered rows per category, those without one under ``None``."""
    return N.category_counts(answered(raw), none_label="None")


def correlations(raw: DataFrame) -> DataFrame:
    """Pearson matrix of body counts and lengths among answered rows."""
    frame = answered(raw).select(
        "q_body_count", "a_body_count",
        X.char_count(F.col("question")).alias("question_len"), X.char_count(F.col("reply")).alias("reply_len"))
    return N.correlations(frame, frame.columns)


def top_category_counts(measures: DataFrame) -> DataFrame:
    """Value counts of the question lengths in the six most frequent categories."""
    return D.value_counts(N.in_top_categories(measures, 6), {"Question": F.col("question_len")}, ["category"])


def _built(entries: dict, only) -> dict[str, DataFrame]:
    """The named entries (all), each made by its function."""
    return {name: make() for name, make in entries.items() if only is None or name in only}


def _summaries(measures: DataFrame) -> dict:
    """Makers of the summaries of a stored measure table."""
    chars = char_lengths(measures)
    return {
        "describe": lambda: D.describe(numeric_counts(measures)),
        "histogram": lambda: D.histogram(chars),
        "histogram_curve": lambda: D.kde(chars, cut=0.0),
        "kde": lambda: D.kde(chars),
        "ecdf": lambda: D.ecdf(chars),
        "boxplot": lambda: D.boxplot(chars),
        "violin": lambda: D.violin(chars),
        "scatter": lambda: D.grid_counts(measures, [("question_len", "reply_len")]),
        "pair_matrix": lambda: pair_matrix(measures),
        "pair_diagonal": lambda: D.kde(numeric_counts(measures)),
        "top_category_boxplot": lambda: D.boxplot(top_category_counts(measures), ["category"]),
        "top_category_mean": lambda: D.mean_interval(N.in_top_categories(measures, 6), "reply_len", "category"),
    }


def profile(raw: DataFrame, only=None) -> dict[str, DataFrame]:
    """All summaries (or those named in ``only``) by name; all but the first two are about the answered rows.

    The texts are read for the profile tables and once for the narrow measure table, which is written
    to the shared folder; the distribution summaries read that.
    """
    kept = answered(raw)
    measures = written(lengths(raw), "measures")
    data_columns = [c for c in raw.columns if c != "row_id"]
    return _built({
        "column_profile": lambda: columns(raw),
        "duplicate_rows": lambda: N.duplicate_rows(raw, data_columns),
        **_summaries(measures),
        "describe_counts": lambda: body_counts(raw),
        "category_counts": lambda: categories(raw),
        "category_share": lambda: N.category_share(kept),
        "correlations": lambda: correlations(raw),
        "top_words_questions": lambda: N.top_words(kept, "question"),
        "top_words_answers": lambda: N.top_words(kept, "reply"),
    }, only)


_LONG, _TEXT = T.LongType(), T.StringType()
#: What is kept of a landed batch: numbers, digests and counts, no texts but the words.
MEASURES = T.StructType([
    T.StructField("row_id", _LONG), T.StructField("category", _TEXT), *[T.StructField(c, _LONG) for c in NUMERIC],
    T.StructField("q_body_count", T.DoubleType()), T.StructField("a_body_count", T.DoubleType())])
COLUMNS = T.StructType([*[T.StructField(c, _TEXT) for c in ("stage", "column", "dtype")], *[T.StructField(c, _LONG) for c in ("n", "non_null", "nulls")]])
DIGESTS = T.StructType([T.StructField("d", T.BinaryType()), T.StructField("n", _LONG)])
WORDS = T.StructType([T.StructField("field", _TEXT), T.StructField("word", _TEXT), T.StructField("n", _LONG)])


class ProfileStore:
    """The profile of a table that grows by batches, kept in ``path``.

    ``add`` reads a batch's texts once and stores what its summaries need: a narrow row of measures for each answered row,
    counts of nulls per column, of rows per 128-bit digest and of words per field. All of it merges by union or by
    sums, so ``profile`` has the entries of ``profile`` over all rows without a second look at old texts. A batch that is
    added again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        def table(name, schema):
            return BatchTable(spark, f"{path.rstrip('/')}/{name}", schema)

        self.measures, self.columns = table("measures", MEASURES), table("columns", COLUMNS)
        self.digests, self.words = table("digests", DIGESTS), table("words", WORDS)

    def add(self, raw: DataFrame, batch_id: int) -> None:
        kept = answered(raw)
        data_columns = [c for c in raw.columns if c != "row_id"]
        bodies = ("q_body_count", "a_body_count")
        self.measures.write(lengths(raw, keep=bodies).select(*[F.col(f.name).cast(f.dataType) for f in MEASURES]), batch_id)
        self.columns.write(columns(raw), batch_id)
        self.digests.write(raw.groupBy(digest(*data_columns).alias("d")).agg(F.count(F.lit(1)).alias("n")), batch_id)
        fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), N.words_of(F.col(c)).alias("words")) for c in ("question", "reply")]))
        words = kept.select(fields.alias("f")).select("f.field", F.explode("f.words").alias("word")).filter(F.length("word") > 2)
        self.words.write(words.groupBy("field", "word").agg(F.count(F.lit(1)).alias("n")), batch_id)

    def profile(self, only=None) -> dict[str, DataFrame]:
        """The entries of ``profile`` (or those named in ``only``) over all batches."""
        measures, stored = self.measures.read(), self.words.read()
        bodies = ["q_body_count", "a_body_count"]
        described = measures.select(*bodies, "question_word_count", "answer_word_count")

        def duplicates():
            counted = self.digests.read().groupBy("d").agg(F.sum("n").alias("n"))
            return counted.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))

        def top_words(field, k=10):
            return N.top(stored.filter(F.col("field") == field).groupBy("word").agg(F.sum("n").alias("n")), "word", k)

        return _built({
            "column_profile": lambda: self.columns.read().groupBy("stage", "column", "dtype").agg(
                *[F.sum(c).alias(c) for c in ("n", "non_null", "nulls")]),
            "duplicate_rows": duplicates,
            **_summaries(measures),
            "describe_counts": lambda: D.describe(D.value_counts(described, {c: F.col(c) for c in described.columns})),
            "category_counts": lambda: N.category_counts(measures, none_label="None"),
            "category_share": lambda: N.category_share(measures),
            "correlations": lambda: N.correlations(measures, [*bodies, "question_len", "reply_len"]),
            "top_words_questions": lambda: top_words("question"),
            "top_words_answers": lambda: top_words("reply"),
        }, only)
