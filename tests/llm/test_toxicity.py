import numpy as np
import pytest

from tamhis.llm import toxicity as X
from tamhis.llm.common import least_shingle

rng = np.random.default_rng(0)
WORDS = [f"word{i}" for i in range(400)]


def texts(n, bad):
    return [" ".join([*rng.choice(WORDS, 60), *(["nasty" + rng.choice(["ly", "er", "", "!"]), "vile"] if bad else [])]) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, int(i % 4 == 0)) for i, t in enumerate(x for k in range(400) for x in texts(1, k % 4 == 0))]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(spark.createDataFrame([(3, None), (None, 1), (5, 7)], "doc_id long, toxic int"))
    return X.fit(table.select("doc_id", "text"), labels)


def brute(model, at, weight, k):
    dense = np.zeros((len(model.labels), len(model.vocabulary)))
    for b in range(len(model.start)):
        for t in range(len(model.vocabulary)):
            s = slice(model.start[b, t], model.start[b, t + 1])
            dense[model.example[s], t] = model.weight[s]
    sims = dense[:, at] @ weight
    order = np.lexsort((np.arange(len(sims)), -sims.astype(np.float32)))
    return [i for i in order[:k] if sims[i] > 1e-9], np.sort(sims)[::-1][:k]


def test_search_equals_all_products(model):
    read = X._Reader(model.vocabulary)
    assert b"vile" in model.vocabulary and b"nast*" in model.vocabulary
    for text in [*texts(15, True), *texts(15, False), "vile", "word1"]:
        at, weight = X._vector(read(text.encode()), model.idf)
        found, sims = model.nearest(at, weight, 10)
        want, best = brute(model, at, weight, 10)
        assert np.allclose(sims, best[: len(sims)], atol=1e-5) and len(found) == len(want)


def test_scores_and_evidence(spark, model):
    rows = [(i, t) for i, t in enumerate(texts(30, True) + texts(30, False))] + [(100, None), (101, ""), (102, "  "), (103, "Vile! " * 50_000)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS why")
    got = X.score(docs, model, keep=docs.columns, out="score", evidence="why").collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 1 and set(got[0].asDict()) == {"doc_id", "text", "score", "why"}
    assert all(found[i].score > 0.5 for i in range(30)) and all(found[i].score < 0.5 for i in range(30, 60))
    assert [found[i].score for i in (100, 101, 102)] == [0, 0, 0] and found[103].score > 0.5
    key, label, cosine = found[0].why.split(",")[0].split(":")
    assert label == "1" and 0 < float(cosine) <= 1 and int(key) % 4 == 0


def test_without_examples(spark):
    docs = spark.createDataFrame([(1, "vile")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(docs, X.fit(docs, none)).first()["score"] == 0
    assert X.score(docs, X.fit(docs.limit(0), none)).first()["score"] == 0


def test_near_copies_share_their_smallest_shingle():
    base = " ".join(f"w{i}" for i in range(300)).encode()
    assert least_shingle(base) == least_shingle(base.upper()) and least_shingle(b"a b") == least_shingle(b" A  B")
    assert sum(least_shingle(base.replace(b"w%d " % i, b"x ")) == least_shingle(base) for i in range(0, 300, 10)) > 25


def test_held_out_accuracy(spark):
    from tamhis.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted[got.toxic == 1] == 1).mean() > 0.85 and (got.predicted[got.toxic == 0] == 1).mean() < 0.01
