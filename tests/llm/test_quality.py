import numpy as np
import pytest

from tamhis.llm import quality as Q

rng = np.random.default_rng(1)
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def texts(n, good):
    return [" ".join(w if good else w.upper() + "!!" for w in rng.choice(WORDS, 50)) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, int(i % 3 > 0)) for i, t in enumerate(x for k in range(300) for x in texts(1, k % 3 > 0))]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return Q.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))


def test_votes_equal_plain_neighbours(model):
    read = Q.Reader()
    latent = model.latent([read(t.encode()) for t in texts(20, True) + texts(20, False)])
    got = model.votes(latent)
    for x, score in zip(latent, got):
        cosines = model.vectors @ x
        near = np.argsort(-cosines, kind="stable")[: Q.NEIGHBOURS]
        weight = np.maximum(cosines[near], 0).astype(float) ** Q.SHARPNESS * model.weights[near]
        assert score == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-3)
    assert (got[:20] > 0.5).all() and (got[20:] < 0.5).all()


def test_features():
    assert Q.shape("Hello!!!!") == "Aaa!!" and Q.shape("A1") == "A0" and Q.shape("") == ""
    at, _ = Q.Reader()(b"x x x x y z q")
    assert {0, 1, 2} <= set(at.tolist()) and 3 not in at
    assert len(Q.Reader()(None)[0]) == len(Q.Reader()(b" ")[0]) == 0


def test_principal_directions():
    m = rng.standard_normal((60, 5)).astype(np.float32) @ rng.standard_normal((5, 200)).astype(np.float32)
    basis = Q.principal(m, 5)
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-4) and np.allclose(m @ basis @ basis.T, m, atol=1e-2)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, " "), (4, texts(1, False)[0]), (4, texts(1, True)[0]), (5, "WA!! " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS h")
    got = Q.score(docs, model, keep=docs.columns).collect()
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0.5] * 3 and len(got) == 6
    assert all(0 <= r.score <= 1 for r in got) and Q.score(docs.limit(0), model).count() == 0
    empty = Q.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in Q.score(docs, empty).collect()} == {0.5}


def test_held_out_accuracy(spark):
    from tamhis.llm.queries import op10_quality

    sf = "/root/testdata/sf0.1"
    got = op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
