import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tamhis.operators.split import split_exact
from tamhis.plans.training import template_records, training_set
from tamhis import profiles as P


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 140, 1000])
def test_sizes_and_members(spark, n):
    got = {r.id: r.split for r in split_exact(spark.range(n), "id").collect()}
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    want = set(order[:math.ceil(0.05 * n)])
    assert {i for i, s in got.items() if s == "test"} == want and len(got) == n


def test_split_depends_on_seed_and_not_on_partitions(spark):
    def members(seed, partitions):
        df = split_exact(spark.range(500).repartition(partitions), "id", 0.1, seed)
        return {r.id for r in df.filter("split = 'test'").collect()}

    assert members(1, 1) == members(1, 7) != members(2, 1)


def test_no_shuffle_of_the_data(spark):
    df = split_exact(spark.range(1000).withColumn("text", F.lit("x")), "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("text" in line for line in exchanges)


def test_chatml(spark):
    df = spark.createDataFrame([(1, " q ", None, "a\n"), (2, "q", " in ", None)],
                               "row_id long, instruction string, input string, output string")
    got = {r.row_id: r.text for r in training_set(df).collect()}
    head = f"<|im_start|>system\n{P.SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\n"
    assert got[1] == head + "q<|im_end|>\n<|im_start|>assistant\na<|im_end|>"
    assert got[2] == head + "q\nin<|im_end|>\n<|im_start|>assistant\n<|im_end|>"
    text = template_records(df).filter("row_id = 1").first()["text"]
    assert text.endswith("### السؤال:\n q \n\n### الإجابة:\na\n<|im_end|>")
