import json
import random

import pytest
from pyspark.sql import functions as F

from tamhis.plans.curate import curate
from tamhis.profiles import LATIN
from tamhis.schemas import RAW_QA
from tamhis.sources import order, readers, writers


def raw(i, question, reply="one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"):
    return {"q_body": None, "a_body": None, "category": "c", "q_body_count": None, "a_body_count": None, "question": question, "reply": f"{reply} {i}"}


def files(folder, sizes, seed=1):
    """JSON files of the given numbers of lines; the rows in the order of paths and lines."""
    rng, rows = random.Random(seed), []
    folder.mkdir()
    for k, n in enumerate(sizes):
        own = [raw(len(rows) + i, f"the question of number {rng.randint(0, 400)}") for i in range(n)]
        (folder / f"part-{k:03d}.json").write_text("".join(json.dumps(r) + "\n" for r in own))
        rows += own
    return rows


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("broadcast_splits", [1 << 20, 0])
def test_numbers_follow_paths_and_lines(spark, tmp_path, small_splits, broadcast_splits):
    rows = files(tmp_path / "a", [5, 3000, 0, 50, 1, 700])
    scan = spark.read.schema(RAW_QA).json(str(tmp_path / "a"))
    assert scan.rdd.getNumPartitions() > 5
    got = order.in_file_order(scan, "number", broadcast_splits=broadcast_splits).collect()
    assert {r.number: r.reply for r in got} == {i: r["reply"] for i, r in enumerate(rows)} and len(got) == len(rows)


def test_first_wins_like_a_walk_through_the_files(spark, tmp_path, small_splits):
    rows = files(tmp_path / "a", [5, 3000, 50, 700])
    want, seen = [], set()
    for r in rows:
        if r["question"] not in seen:
            seen.add(r["question"])
            want.append((r["question"], r["reply"]))
    records = curate(readers.read_raw_qa(spark, str(tmp_path / "a"), "json"), LATIN)
    assert [(r.instruction, r.output) for r in records.orderBy("row_id").collect()] == want
    # written and read again, the records keep their order
    assert writers.write_instructions(records, str(tmp_path / "out"), "row_id") == len(want)
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x["instruction"], x["output"]) for x in lines] == want
    again = order.in_file_order(spark.read.schema("instruction string, output string").json(str(tmp_path / "out")))
    assert [(r.instruction, r.output) for r in again.orderBy("row_id").collect()] == want


@pytest.mark.parametrize("fmt", ["parquet", "csv", "multi-line csv", "multi-line json"])
def test_other_formats(spark, tmp_path, fmt):
    path, multi = str(tmp_path / "x"), fmt.startswith("multi")
    rows = [("a\nb" if multi else "a", i) for i in range(3000)]
    kind = fmt.split()[-1]
    if fmt == "multi-line json":
        (tmp_path / "x").mkdir()
        for k, (a, b) in enumerate([(0, 10), (10, 2500), (2500, 3000)]):
            (tmp_path / "x" / f"{k}.json").write_text(json.dumps([raw(i, q, "x") for q, i in rows[a:b]]))
    else:
        for k, (a, b) in enumerate([(0, 10), (10, 2500), (2500, 3000)]):
            part = spark.createDataFrame(rows[a:b], "question string, n int").selectExpr(
                "CAST(NULL AS STRING) AS q_body", "CAST(NULL AS STRING) AS a_body", "'c' AS category", "CAST(NULL AS DOUBLE) AS q_body_count",
                "CAST(NULL AS DOUBLE) AS a_body_count", "question", "concat('x ', n) AS reply")
            writer = part.coalesce(1).write.format(kind)
            (writer.options(header=True, quote='"', escape='"') if kind == "csv" else writer).save(f"{path}/{k}")
    got = readers.read_raw_qa(spark, path if fmt == "multi-line json" else f"{path}/*", kind, multi_line=multi)
    assert got.count() == 3000
    assert got.filter(F.col("reply") != F.concat(F.lit("x "), F.col("row_id"))).count() == 0


def test_files_dealt_differently_fail_the_job(spark, tmp_path):
    files(tmp_path / "a", [5, 3000, 50, 700])
    scan = spark.read.schema(RAW_QA).json(str(tmp_path / "a"))
    numbered = order.in_file_order(scan)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        with pytest.raises(Exception, match="dealt differently"):
            numbered.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nothing_to_number(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    assert readers.read_raw_qa(spark, str(tmp_path / "a.json"), "json").count() == 0


def test_data_are_not_moved(spark, tmp_path):
    files(tmp_path / "a", [50, 300])
    plan = readers.read_raw_qa(spark, str(tmp_path / "a"), "json")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Sort " not in plan
