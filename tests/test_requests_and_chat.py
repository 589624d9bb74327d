from pyspark.sql import functions as F

from tamhis import profiles as P
from tamhis.functions.chat import panel_prompt, prompt_messages, render_messages
from tamhis.operators import requests as R
from tamhis.operators.chat import render_conversations
from tamhis.schemas import REQUEST


def test_validation(spark):
    rows = [
        ("ok", "hello", None, None), ("low", "hello", 64, 0.1), ("high", "hello", 1024, 1.5),
        ("short", "h", None, None), ("long", "x" * 2001, None, None), ("max", "x" * 2000, None, None),
        ("none", None, None, None), ("blank", "  \n", None, None), ("tokens", "hello", 63, 0.3),
        ("both", "hello", 1025, 1.6), ("nan", "hello", None, float("nan")), ("blank_short", " ", None, None),
    ]
    got = {r.request_id: r for r in R.validate_requests(spark.createDataFrame(rows, REQUEST)).collect()}
    assert {k: (r.status, r.error) for k, r in got.items()} == {
        "ok": (200, None), "low": (200, None), "high": (200, None), "short": (422, "message"),
        "long": (422, "message"), "max": (200, None), "none": (422, "message"), "blank": (400, P.EMPTY_MESSAGE),
        "tokens": (422, "max_tokens"), "both": (422, "max_tokens,temperature"), "nan": (422, "temperature"),
        "blank_short": (422, "message"),
    }
    assert (got["ok"].max_tokens, got["ok"].temperature) == (512, 0.3)


def test_response_record(spark):
    df = spark.createDataFrame([(1, "  hi\n", 1.23456)], "id long, answer string, took double")
    assert R.response_records(df, "answer", "took", "cpu", True).first().asDict() == {
        "id": 1, "response": "hi", "elapsed_seconds": 1.23, "device": "cpu", "rag": True, "disclaimer": P.DISCLAIMER}


def test_compare_and_report(spark):
    answers = spark.createDataFrame([(1, "base", "x"), (1, "tuned", "y"), (2, "base", "z")],
                                    "question_id long, model string, answer string")
    got = R.compare_answers(answers, ["base", "tuned"]).orderBy("question_id").collect()
    assert [tuple(r) for r in got] == [(1, "x", "y"), (2, "z", None)]
    panel = R.panel(spark, ["one?", "two?"])
    got = R.answer_panel(panel, answers.filter("model = 'tuned'")).orderBy("question_id").collect()
    assert [(r.question, r.answer) for r in got] == [("one?", "y"), ("two?", "")]  # every question is listed
    line = spark.createDataFrame([("q", "a")], "question string, answer string").select(R.report_lines()).first()[0]
    assert line == "السؤال: q\nالجواب: a"


def test_conversations_are_whole_and_in_order(spark):
    turns = spark.range(700).select(
        F.when(F.col("id") < 600, 1).otherwise(2).alias("conv_id"),
        (F.when(F.col("id") < 600, F.col("id")).otherwise(F.col("id") - 600) * 1000).alias("turn"),
        F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text")).repartition(7)
    want = "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(600)) + "<|im_start|>assistant\n"
    rows = render_conversations(turns).orderBy("conv_id").collect()
    assert [(r.conv_id, r.part) for r in rows] == [(1, 0), (2, 0)] and rows[0].chat == want
    parts = render_conversations(turns, turns_per_row=256).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.chat.count("<|im_end|>")) for r in parts] == [(1, 0, 256), (1, 1, 256), (1, 2, 88), (2, 0, 100)]
    assert "".join(r.chat for r in parts if r.conv_id == 1) == want
    assert render_conversations(turns, generation_prompt=False).filter("conv_id = 2").first()["chat"].endswith("<|im_end|>\n")
    assert "Join" not in render_conversations(turns)._jdf.queryExecution().executedPlan().toString()


def test_panel_prompt(spark):
    got = spark.createDataFrame([("q?",)], "q string").select(panel_prompt(F.col("q"))).first()[0]
    assert got == (f"<|im_start|>system\n{P.PANEL_HEAD}q?{P.PANEL_TAIL}<|im_end|>\n<|im_start|>user\nq?<|im_end|>\n"
                   "<|im_start|>assistant\n")


def test_render_messages(spark):
    df = spark.createDataFrame([("hi",)], "q string")
    got = df.select(render_messages(prompt_messages(F.col("q"), system="S"), generation_prompt=False)).first()[0]
    assert got == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
