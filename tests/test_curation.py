from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tamhis.operators import curation as C
from tamhis.plans.curate import curate, curation_funnel, valid_pairs
from tamhis.schemas import RAW_QA
from tamhis.profiles import LATIN
from workloads import adapters as A

LONG = "يجب على المريض ان يشرب الماء وان ينام جيدا وان يراجع الطبيب كل شهر مرة واحدة على الاقل"
COLUMNS = "row_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_QA)


def raw(spark, *rows):
    """Rows as (question, reply) with the other columns empty."""
    return spark.createDataFrame(
        [(i, None, None, "عام", None, None, q, a) for i, (q, a) in enumerate(rows)], COLUMNS)


def reasons(df):
    flags = C.gate_flags(C.with_qa(df))
    return [r[0] for r in flags.select(C.reject_reason(), "row_id").orderBy("row_id").collect()]


def test_rows_shaped_like_the_source_are_all_rejected(spark):
    rows = spark.createDataFrame([
        (0, None, None, "جراحة", None, None, "\nيوجد الم بعد عمليه في القدم", "راجع الطبيب\n0\n عامة"),
        (1, "عندي بلغم شديد منذ زمن", "السؤال غير واضح", "صدرية", 5.0, 3.0, None, None),
        (2, None, None, "قلب", None, None, "\nاعاني من صداع ، هل هي اعراض الضغط", LONG + "\n0\n عامة"),
        (3, None, None, "باطنية", None, None, "\nوزني كبير كيف اخفضه", LONG + "\n1\nد. فلان\n طب عام"),
        (4, None, None, "صدرية", None, None, "\nقال الدكتور لي خذ هذا ماذا افعل", LONG),
    ], COLUMNS)
    assert curate(rows).count() == 0
    assert reasons(rows) == ["short", "short", "personal", "personal", "personal"]


def test_gates_one_by_one(spark):
    df = raw(
        spark,
        ("ما هي اسباب الصداع", LONG),            # kept
        ("", LONG), ("ما هي اسباب", None),       # empty
        ("ما هي", LONG), ("ما هي اسباب الصداع", "قصير"),  # short
        ("سؤال عام جدا", LONG),                   # not_general
        ("هل السنوي مفيد", LONG),                 # personal: substring of a longer word
        ("شيء سهل جدا", LONG),                    # kept: a general keyword inside a word
        ("ما  هي الفوائد", LONG),                 # not_general: two spaces
        ("كيييف الحال اليوم", LONG),              # kept: squeezed run
        ("مَتى الدواء اليوم", LONG),               # kept: mark dropped, letter folded
        ("اب هل أُمِّي هنا", LONG),                 # personal after normalisation
    )
    assert reasons(df) == [None, "empty", "empty", "short", "short", "not_general", "personal", None,
                           "not_general", None, None, "personal"]


def test_fields_are_chosen_independently(spark):
    df = spark.createDataFrame(
        [(1, "", "q", "b", "o", None, "c"), (2, None, "", "b", "", "r", "c"), (3, "i", "q", "b", None, "", ""),
         (4, None, None, None, None, None, None), (5, " ", "q", None, None, None, " ")],
        "row_id long, instruction string, question string, q_body string, output string, reply string, a_body string")
    got = [tuple(r) for r in C.with_qa(df).orderBy("row_id").select("q", "a").collect()]
    assert got == [("q", "o"), ("b", "r"), ("i", ""), ("", ""), (" ", " ")]
    assert C.with_qa(df.select("row_id", "question")).filter("row_id = 1").first()["a"] == ""


def test_cleaned_texts_may_be_empty_and_first_wins(spark):
    urls = "http://ما.هي www.ما.هي http://هل"
    df = raw(
        spark, ("ما هي اسباب الصداع www.x.y", LONG + " ثانيا\nد. فلان"), ("ما هي  اسباب   الصداع", LONG),
        ("http://a ما http://هل", LONG), (urls + " http://ما هي", LONG),
        ("http://ماذا www.b www.c", "http://a " * 15), ("www.ماذا www.e www.f", LONG))
    got = {r.row_id: (r.instruction, r.input, r.output) for r in curate(df).collect()}
    assert got[0] == ("ما هي اسباب الصداع", "", LONG + " ثانيا")
    assert 1 not in got
    assert got[4] == ("", "", "") and 5 not in got  # one empty question survives, the first
    assert curation_funnel(df).first()["n_unique"] == len(got)


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_result_does_not_depend_on_partitions(spark, partitions):
    rows = [(f"que es {i % 7} esto the", "word " * 20 + str(i)) for i in range(400)]
    got = curate(raw(spark, *rows).repartition(partitions), LATIN).collect()
    assert sorted(r.row_id for r in got) == list(range(7))


def test_first_per_key_keeps_one_row_of_a_hot_key(spark):
    df = spark.range(30000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = C.first_per_key(df.repartition(6), "k", "row_id")
    assert got.count() == 20001
    assert got.filter("k = 'hot'").first()["row_id"] == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_digest_tells_null_from_empty_and_boundaries(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("1:a", ""), ("a", "b")], "x string, y string")
    assert df.select(C.digest("x", "y")).distinct().count() == 5


@pytest.mark.parametrize("lists", [{"personal": ()}, {"general": ()}, {"personal": (), "general": ()}])
def test_empty_keyword_lists(spark, lists):
    """Nothing matches an empty list: no personal word refuses, no general word keeps."""
    profile = replace(LATIN, **lists)
    rows = A.raw_qa(spark, "/root/testdata/sf0.001")
    flags = C.gate_flags(C.with_qa(rows), profile)
    valid = valid_pairs(rows, profile).count()
    funnel = curation_funnel(rows, profile).first()
    assert valid == flags.filter(C.reject_reason().isNull()).count() == funnel.n_not_personal
    assert curate(rows, profile).count() == funnel.n_unique
    assert (valid > 0) == ("general" not in lists)
