import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tamhis.plans.curate import curate
from tamhis.schemas import INSTRUCTION
from tamhis.sources import readers, writers
from tamhis.workspace import release, shared_dir, written


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


GOOD = '{"instruction": "سؤال", "input": "", "output": "a\\nb"}\n'


def test_strict_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", GOOD + "\n   \n" + '{"output": "x"}\n')
    got = readers.read_jsonl_strict(spark, path).collect()
    assert [tuple(r) for r in got] == [("سؤال", "", "a\nb"), (None, None, "x")]
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, write(tmp_path / "b.jsonl", GOOD + "{broken\n")).collect()


def test_tolerant_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", GOOD + "\n{broken\n \nplain\n" + '{"output": "x"}\n')
    got = readers.read_jsonl_tolerant(spark, path).collect()
    assert [tuple(r) for r in got] == [("سؤال", "", "a\nb"), ("", "", "x")]
    assert sorted(r.line for r in readers.rejected_lines(spark, path).collect()) == ["plain", "{broken"]
    assert readers.rejected_lines(spark, path).count() == 2


def test_rejects_are_counted_in_the_same_pass(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", GOOD * 6 + "\n{broken\n \nplain\n")
    seen = Observation()
    df = readers.read_jsonl_tolerant(spark, path, seen=seen)
    assert df.count() == 6 and seen.get == {"lines": 8, "rejected": 2}
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    before = set(os.listdir(shared_dir(spark)))
    records, counts = readers.read_jsonl_within(spark, path, 0.25)
    assert records.count() == 6 and counts == {"lines": 8, "rejected": 2}
    release(records)
    with pytest.raises(readers.TooManyRejects, match="2 of 8"):
        readers.read_jsonl_within(spark, path, 0.24)
    assert set(os.listdir(shared_dir(spark))) == before  # nothing of a refused source is left
    empty, counts = readers.read_jsonl_within(spark, write(tmp_path / "b.jsonl", "\n"), 0.0)
    assert empty.count() == 0 and counts == {"lines": 0, "rejected": 0}


BAD = ["{'instruction': 'x'}", '{"output": "x"} junk', '{"output": "x"}{"output": "y"}', '[{"output": "x"}]', '"text"', "{broken"]


def test_lines_that_are_not_one_object(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", "\n".join([*BAD, "\u00a0", '  {"output": "good"} ']) + "\n")
    assert [r.output for r in readers.read_jsonl_tolerant(spark, path).collect()] == ["good"]
    assert sorted(r.line for r in readers.rejected_lines(spark, path).collect()) == sorted(BAD)
    for k, line in enumerate(BAD):
        one = write(tmp_path / f"{k}.jsonl", GOOD + line + "\n")
        with pytest.raises(Exception, match="not one JSON object"):
            readers.read_jsonl_strict(spark, one).collect()
    blank = write(tmp_path / "blank.jsonl", GOOD + "\u00a0\n")
    assert readers.read_jsonl_strict(spark, blank).count() == 1


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'text\n"one\ntwo ""quoted"", end"\nplain\n')
    assert [r.text for r in readers.read_training_csv(spark, path).collect()] == ['one\ntwo "quoted", end', "plain"]


def test_raw_formats(spark, tmp_path):
    rows = [{"q_body": None, "a_body": None, "category": "c", "q_body_count": None, "a_body_count": None,
             "question": f"\nq{i}", "reply": "r\n0\n x"} for i in range(3)]
    array = write(tmp_path / "a.json", json.dumps(rows, ensure_ascii=False, indent=1))
    df = readers.read_raw_qa(spark, array, "json", multi_line=True)
    assert [r.question for r in df.orderBy("row_id").collect()] == ["\nq0", "\nq1", "\nq2"]
    df.withColumn("key", F.col("row_id") + 7).write.parquet(str(tmp_path / "p"))
    keyed = readers.read_raw_qa(spark, str(tmp_path / "p"), row_id="key")
    assert [r.row_id for r in readers.head(keyed, 2).collect()] == [7, 8]
    assert keyed.columns[:7] == df.columns[:7]


def test_instruction_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "س", "", "a\nb"), (2, "q", "", "")], "row_id long, instruction string, input string, output string")
    path = str(tmp_path / "out")
    assert writers.write_instructions(df, path) == 2
    assert writers.write_instructions(df.limit(0), path) == 0
    assert writers.write_instructions(df.limit(1), path) == 1
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ['{"instruction":"س","input":"","output":"a\\nb"}']
    assert readers.read_jsonl_strict(spark, path).schema == INSTRUCTION


def test_index_report_and_training(spark, tmp_path):
    index = spark.createDataFrame([(1, "t", [0.5, 0.25])], "doc_id long, doc_text string, embedding array<double>")
    writers.write_index(index, str(tmp_path / "index"))
    assert readers.read_index(spark, str(tmp_path / "index")).first()["embedding"] == [0.5, 0.25]
    qa = spark.createDataFrame([(i, f"q{i}", "a") for i in range(50)], "n long, question string, answer string").repartition(7)
    writers.write_report(qa, str(tmp_path / "report"), "n")
    files = sorted((tmp_path / "report").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines == [x for i in range(50) for x in (f"السؤال: q{i}", "الجواب: a")]
    writers.write_training(spark.createDataFrame([("x", "train"), ("y", "test")], "text string, split string"), str(tmp_path / "t"))
    assert [r.text for r in spark.read.json(str(tmp_path / "t/split=test")).collect()] == ["y"]


def test_written_tables_live_in_the_configured_folder(spark):
    df = written(spark.range(5), "numbers")
    assert df.count() == 5
    assert all(shared_dir(spark) in f for f in df.inputFiles())
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_release_deletes_what_was_written_and_nothing_else(spark, tmp_path):
    df = written(spark.range(5), "numbers")
    folder = df.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    release(df)
    assert not os.path.exists(folder)
    spark.range(3).write.parquet(str(tmp_path / "own"))
    release(spark.read.parquet(str(tmp_path / "own")))
    assert (tmp_path / "own").exists()


def test_curation_reads_only_the_columns_it_needs(spark, tmp_path):
    columns = "q_body string, a_body string, category string, q_body_count double, a_body_count double, question string, reply string, id long"
    spark.createDataFrame([(None, None, "c", None, None, "q", "r", 1)], columns).write.parquet(str(tmp_path / "raw"))
    raw = readers.read_raw_qa(spark, str(tmp_path / "raw"), row_id="id")
    plan = curate(raw)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "reply" in scan and "category" not in scan and "q_body_count" not in scan
