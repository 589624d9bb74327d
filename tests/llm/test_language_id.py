import numpy as np
import pytest

from tamhis.llm import language_id as L

TRAIN = [("the cat and the dog", "en"), ("the house", "en"), ("der hund und die katze", "de"), ("das haus", "de"),
         (None, "de"), ("ignored", None), ("", "en")]


def test_model_and_backoff(spark):
    model = L.fit(spark.createDataFrame(TRAIN, "text string, lang string"))
    assert model.languages == ["de", "en"] and "the" in model.words and "katze" in model.words
    assert model.scores("the").argmax() == 1 and model.scores("hund").argmax() == 0
    known = [model.grams[g] for g in L.grams("katzen", 4) if g in model.grams]
    assert known and np.allclose(model.scores("katzen"), model.gram_logs[known].mean(axis=0))
    assert (model.scores("qqqq") == 0).all()  # no n-gram is known
    one = [model.grams[g] for g in L.grams("xtx", 1) if g in model.grams]
    assert np.allclose(model.scores("xtx"), model.gram_logs[one].mean(axis=0))


def test_counts_equal_plain_counting(spark):
    model = L.fit(spark.createDataFrame(TRAIN * 3, "text string, lang string").repartition(4))
    words = {}
    for text, lang in TRAIN * 3:
        for w in (text or "").split() if lang else ():
            words.setdefault(w, [0, 0])[["de", "en"].index(lang)] += 1
    table = np.array([words[w] for w in model.words], float)
    assert set(words) == set(model.words)
    want = np.log((table + L.SMOOTHING) / (table.sum(axis=0) + L.SMOOTHING * len(table)))
    assert np.allclose(model.word_logs, want, atol=1e-5)


def test_edges(spark):
    model = L.fit(spark.createDataFrame(TRAIN, "text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !! 4"), (4, "The cat!"), (5, "DER hund"), (4, "The cat!"), (6, "the " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS score", "0 AS text_bytes")
    got = sorted((r.doc_id, r.lang_pred) for r in L.identify(docs, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "en")]
    scores = {r.doc_id: r.score for r in L.identify(docs, model, keep=docs.columns).collect()}
    assert scores[1] == 0 and all(0 <= s <= 1 for s in scores.values()) and scores[6] == pytest.approx(1)
    empty = L.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from tamhis.llm.queries import op4_language_id

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op4_language_id(spark, sf).join(docs, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count() > 200


def test_a_frequent_language_does_not_displace_a_rare_one(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26 ** k % 26] for k in range(5)) for i in range(0, 60_000 * 197, 197)]
    train = [(" ".join(words[k:k + 500] * 3), "en") for k in range(0, len(words), 500)] + [("αβγδ εζηθ λαβγδικ", "xx")]
    model = L.fit(spark.createDataFrame(train, "text string, lang string"))
    rows = [(1, "αβγδ εζηθ"), (2, "αβγδικλ"), (3, f"{words[0]} {words[-1]}"), (4, "εζηθ " * 3), (4, "εζηθ " * 3), (5, "шшш"), (6, "7 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.identify(docs, model).collect()
    want = {1: "xx", 2: "xx", 3: "en", 4: "xx", 5: "en", 6: "und"}
    assert len(got) == len(rows) and all(r.lang_pred == want[r.doc_id] for r in got)
    scores = {r.doc_id: r.score for r in got}
    for i, words_of in ((1, ["αβγδ", "εζηθ"]), (2, ["αβγδικλ"]), (4, ["εζηθ"] * 3)):
        total = sum(model.scores(w).astype(float) for w in words_of)
        assert scores[i] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-5)
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and scores[5] == pytest.approx(0.5)
