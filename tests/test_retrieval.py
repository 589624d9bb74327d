import math
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis import profiles as P
from tamhis.operators.embedding import BatchEncoder, TfidfEncoder
from tamhis.operators.nearest import left_out, nearest
from tamhis.plans import retrieval as R


def vectors(spark, name, ids, matrix):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)],
                                 f"{name} long, embedding array<float>")


def brute_force(queries, docs, k):
    """{query: [(distance, doc)]} with the float values Spark stores."""
    want = {}
    for q, qv in queries.items():
        gaps = [(math.sqrt(((qv - dv) ** 2).sum()), d) for d, dv in docs.items()]
        want[q] = sorted(gaps)[:k]
    return want


@pytest.mark.parametrize("block_bytes", [1 << 25, 3000])  # one block; several
@pytest.mark.parametrize("k", [1, 2, 5])
def test_any_block_size_equals_brute_force(spark, block_bytes, k):
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(300, 8)).astype(np.float32)
    docs[50:150] = docs[50]  # a group of copies holds a third of the rows
    queries = np.vstack([rng.normal(size=(10, 8)).astype(np.float32), docs[50:80]])
    index = vectors(spark, "doc_id", range(1000, 1300), docs).repartition(5)
    asked = vectors(spark, "query_id", range(40), queries)
    got = {}
    for r in nearest(index, asked, k, block_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.doc_id))
    want = brute_force(dict(enumerate(queries.astype(float))), dict(zip(range(1000, 1300), docs.astype(float))), k)
    assert {q: [d for _, d in hits] for q, hits in got.items()} == {q: [d for _, d in hits] for q, hits in want.items()}
    for q in want:
        assert [g for g, _ in got[q]] == pytest.approx([w for w, _ in want[q]], abs=1e-12)


@pytest.mark.parametrize("block_bytes", [1 << 25, 100])
def test_fewer_documents_than_k(spark, block_bytes):
    index = vectors(spark, "doc_id", [7], [[0.0, 1.0]])
    asked = vectors(spark, "query_id", range(9), [[1.0, i] for i in range(9)])
    assert nearest(index, asked, 3, block_bytes).count() == 9
    assert nearest(index.limit(0), asked, 3, block_bytes).count() == 0
    assert nearest(index, asked.limit(0), 3, block_bytes).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 25, 500])
def test_unusable_vectors_leave_the_other_hits_alone(spark, block_bytes):
    rng = np.random.default_rng(1)
    docs, asked = rng.normal(size=(200, 4)).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(docs)]
    bad = [(1000, [float("nan"), 0.0, 0.0, 0.0]), (1001, [float("inf"), 0.0, 0.0, 0.0]), (1002, [None, 0.0, 0.0, 0.0]),
           (1003, [0.0, 0.0]), (1004, []), (1005, None)]
    schema = "doc_id long, embedding array<float>"
    index = spark.createDataFrame(rows[:90] + bad + rows[90:], schema).coalesce(2)
    queries = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(asked)] + [(10, [float("nan")] * 4), (11, None), (12, [0.0, 0.1])],
        "query_id long, embedding array<float>")
    got = {}
    for r in nearest(index, queries, 2, block_bytes).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    want = brute_force(dict(enumerate(asked.astype(float))), dict(enumerate(docs.astype(float))), 2)
    assert got.pop(12) == {1: 1003}  # a query meets the vectors of its own length
    assert got == {q: {1: hits[0][1], 2: hits[1][1]} for q, hits in want.items()}
    assert left_out(index).first()[0] == 5 and left_out(queries).first()[0] == 2


@pytest.mark.parametrize("block_bytes", [1 << 25, 100])
def test_text_query_ids(spark, block_bytes):
    index = vectors(spark, "doc_id", [3, 4], [[0.0, 1.0], [1.0, 0.0]])
    asked = spark.createDataFrame([(f"q{i}", [float(i % 2), 0.2]) for i in range(12)], "query_id string, embedding array<double>")
    got = {r.query_id: r.doc_id for r in nearest(index, asked, 1, block_bytes).collect()}
    assert got == {f"q{i}": 4 if i % 2 else 3 for i in range(12)}


def test_tfidf_equals_plain_python(spark):
    texts = ["The cat the dog", "cat bird", "", None, " dog dog dog ", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(3)
    encoder = TfidfEncoder(32).fit(df, "t")
    got = {r.doc_id: r.embedding for r in encoder.encode(df, "t").collect()}

    counted = [Counter(int(md5(w.encode()).hexdigest()[:4], 16) % 32 for w in (t or "").lower().split()) for t in texts]
    for i, tf in enumerate(counted):
        want = [tf[b] * math.log((len(texts) + 1) / (sum(b in c for c in counted) + 1)) for b in range(32)]
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in want])


def test_batch_encoder_loads_the_model_once_per_task(spark):
    def make():
        calls = []

        def model(texts):
            calls.append(len(texts))
            return [[len(t), len(calls)] for t in texts]

        return model

    df = spark.range(10).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).coalesce(1)
    got = BatchEncoder(make).encode(df, "t").orderBy("id").collect()
    assert [r.embedding[0] for r in got] == list(range(10)) and got[0].t == ""


def test_batch_encoder_sees_each_text_once_and_pads_little(spark, tmp_path):
    log = str(tmp_path)

    def make():
        import os
        import uuid

        def model(texts):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as file:
                file.write("\n".join(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    rows = [(i, "common" if i % 3 == 0 else None if i % 31 == 0 else "t" * (i * 7 % 400 + 1), [i, i + 1], {"k": str(i)}, (i, "s")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string, a array<long>, m map<string,string>, s struct<x:long,y:string>").repartition(5)
    got = BatchEncoder(make, batch=16).encode(df, "t")
    assert got.columns == [*df.columns, "embedding"]
    found = {r.id: r for r in got.collect()}
    assert len(found) == 3000
    for i, t, a, m, s in rows:
        r = found[i]
        assert (r.a, r.m, tuple(r.s), r.t, r.embedding) == (a, m, s, t, [float(len(t or "")), 1.0])
    batches = [f.read_text().split("\n") for f in tmp_path.iterdir()]
    seen = [t for b in batches for t in b]
    assert len(seen) == len(set(seen)) == len({t or "" for _, t, *_ in rows})  # a counting model sees each text once
    assert all(len(b) <= 16 for b in batches)
    padded = sum(len(b) * max(map(len, b)) for b in batches)
    assert padded < 1.25 * sum(map(len, seen))  # texts of similar length go together


def test_batch_encoder_takes_arrow_and_ragged_vectors(spark):
    def arrow():
        import pyarrow as pa
        import pyarrow.compute as pc

        return lambda texts: pa.FixedSizeListArray.from_arrays(pc.utf8_length(texts).cast(pa.float32()), 1)

    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "ab")], "id long, t string")
    assert {r.id: r.embedding for r in BatchEncoder(arrow, arrow=True).encode(df, "t").collect()} == {1: [2.0], 2: [0.0], 3: [0.0], 4: [2.0]}
    ragged = BatchEncoder(lambda: lambda texts: [[1.0] * len(t) for t in texts]).encode(df, "t").collect()
    assert {r.id: r.embedding for r in ragged} == {1: [1.0, 1.0], 2: [], 3: [], 4: [1.0, 1.0]}
    assert BatchEncoder(arrow, arrow=True).encode(df.limit(0), "t").count() == 0


def test_documents_skip_blank_sides(spark):
    df = spark.createDataFrame(
        [(1, " q", "in ", " a "), (2, "", " ", "a"), (3, "q", "", " "), (4, None, "x", "a"), (5, "q", None, "a")],
        "row_id long, instruction string, input string, output string")
    assert {r.doc_id: r.doc_text for r in R.documents(df).collect()} == {
        1: "medical question: q in\n medical answer: a", 4: "medical question: x\n medical answer: a",
        5: "medical question: q\n medical answer: a"}


def test_prompts(spark):
    index = spark.createDataFrame([(1, "one", [0.0, 0.0]), (2, "two", [1.0, 0.0]), (3, "three", [5.0, 5.0])],
                                  "doc_id long, doc_text string, embedding array<float>")
    requests = spark.createDataFrame([("r1", 10, "hi", [0.9, 0.0]), ("r2", 10, "again", [0.9, 0.0])],
                                     "request_id string, query_id long, message string, embedding array<float>")
    got = {r.request_id: r.prompt for r in R.rag_prompts(requests, index).collect()}
    system = f"<|im_start|>system\n{P.SYSTEM_PROMPT}\n{P.RAG_INSTRUCTION}<|im_end|>\n"
    user = f"<|im_start|>user\n{P.REFERENCE_HEADER}\ntwo\n\none\n\n{P.QUESTION_HEADER}\nhi<|im_end|>\n"
    assert got["r1"] == system + user + "<|im_start|>assistant\n"
    assert got["r2"] == got["r1"].replace("\nhi<", "\nagain<")
    plain = R.plain_prompts(requests).filter("request_id = 'r1'").first()["prompt"]
    assert plain == (f"<|im_start|>system\n{P.SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
                     "<|im_start|>assistant\n")


def test_requests_of_one_id_keep_their_own_context(spark):
    index = spark.createDataFrame([(1, "zero", [0.0]), (2, "five", [5.0])], "doc_id long, doc_text string, embedding array<float>")
    requests = spark.createDataFrame([("a", 1, "m", [0.0]), ("b", 1, "m", [5.0]), ("c", 1, "m", None), ("d", 1, "m", [float("nan")])],
                                     "request_id string, query_id long, message string, embedding array<float>")
    got = {r.request_id: r.prompt for r in R.rag_prompts(requests, index, k=1).collect()}
    assert "zero" in got["a"] and "five" not in got["a"] and "five" in got["b"] and "zero" not in got["b"]
    plain = R.plain_prompts(requests).first()["prompt"]
    assert got["c"] == got["d"] == plain


def test_every_text_is_encoded_once(spark, tmp_path):
    def make():
        import os
        import uuid

        def model(texts):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as file:
                file.write("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    log = str(tmp_path)
    records = spark.range(30).select(F.col("id").alias("row_id"), F.repeat(F.lit("q"), (F.col("id") + 1).cast("int")).alias("instruction"),
                                     F.lit("").alias("input"), F.lit("a").alias("output"))
    requests = spark.range(20).select(F.col("id").cast("string").alias("request_id"), F.repeat(F.lit("m"), (F.col("id") + 1).cast("int")).alias("message"))
    encoder = BatchEncoder(make)
    R.rag_prompts(encoder.encode(requests, "message"), R.build_index(records, encoder)).collect()
    seen = [t for f in tmp_path.iterdir() for t in f.read_text().split("\n medical answer: a")[0:] if t.strip()]
    lines = [t for f in tmp_path.iterdir() for t in f.read_text().split("\n") if t.startswith(("medical question", "m"))]
    assert seen and len(lines) == 50 and len(set(lines)) == 50


def test_dense_vectors_of_any_width(spark):
    df = spark.createDataFrame([(i, f"w{i} w{i % 7}") for i in range(300)], "doc_id long, t string")
    encoder = TfidfEncoder(20000).fit(df, "t")
    rows = encoder.encode(df, "t").collect()
    assert len(rows) == 300 and all(len(r.embedding) == 20000 and abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows)


def test_few_hits_do_not_shuffle_the_index_texts(spark):
    index = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("doc_text"), F.array(F.col("id").cast("float")).alias("embedding"))
    queries = spark.createDataFrame([(1, [3.2])], "query_id long, embedding array<float>")
    contexts = R.retrieve_context(index, queries)
    assert contexts.first()["context"] == "text\n\ntext"
    plan = contexts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_missing_index_rows_give_an_empty_context(spark):
    index = spark.createDataFrame([], "doc_id long, doc_text string, embedding array<float>")
    requests = spark.createDataFrame([("r", 1, "hi", [0.0])],
                                     "request_id string, query_id long, message string, embedding array<float>")
    assert f"{P.REFERENCE_HEADER}\n\n\n{P.QUESTION_HEADER}\nhi" in R.rag_prompts(requests, index).first()["prompt"]


def test_executors_do_not_need_the_package(tmp_path):
    """The functions sent to Python workers are shipped whole, so only numpy and pyarrow must be installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tamhis.operators.embedding import _hashing
    from tamhis.operators.nearest import _top_k

    shipped = tmp_path / "functions.pkl"
    shipped.write_bytes(cloudpickle.dumps((_top_k(2), _hashing(16))))
    code = (
        "import pickle, sys, numpy as np, pyarrow as pa\n"
        f"(start, merge, matrix, rows), hashing = pickle.load(open({str(shipped)!r}, 'rb'))\n"
        "best = start(1)\n"
        "merge(best, np.zeros((1, 2)), np.array([4, 5]), np.array([[1.0, 0.0], [0.0, 0.0]]))\n"
        "assert rows(best, pa.array(['x']))['doc_id'].tolist() == [5, 4]\n"
        "assert len(hashing(pa.array([['a', 'b'], []]))[0]) == 2\n"
        "assert 'tamhis' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)
