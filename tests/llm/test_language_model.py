import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamhis.llm import language_model as L

TEXTS = ["the cat saw the dog", "The dog saw a cat a cat", "a cat", "", None, "the the the zebra", "x y z the cat", "unseen the words here",
         "the cat saw the dog"]


def plain(texts, learn, classes):
    """Counts, and the log10 probabilities straight from the formulas."""
    lines = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    tokens = [w + ["</s>"] for w in lines]
    count = Counter(w for w, use in zip(tokens, learn) if use for w in w)
    total, distinct = sum(count.values()), len(count)
    top = sorted((w for w in count if w != "</s>"), key=lambda w: (-count[w], L.word_key(w.encode())))[:classes]

    def unigram(w):
        return (count[w] + 0.5) / (total + 0.5 * (distinct + 1))

    rare = 1 - unigram("</s>") - sum(map(unigram, top))
    group = lambda w: w if w == "</s>" or w in top else None
    p1 = lambda c: rare if c is None else unigram(c)
    grams = Counter()
    for line, use in zip(tokens, learn):
        if use:
            c = ["</s>", *map(group, line)]
            grams.update(zip(c, c[1:]))
            grams.update(zip(c, c[1:], c[2:]))
    size = Counter(group(w) for w in count.elements())
    m1, m2 = L.PRIORS[1:]
    p2 = lambda a, x: (grams[a, x] + m1 * p1(x)) / (size[a] + m1)
    p3 = lambda a, b, x: (grams[a, b, x] + m2 * p2(b, x)) / (grams[a, b] + m2)
    out = []
    for line in tokens:
        c = ["</s>", *map(group, line)]
        score = math.log10(p2(c[0], c[1])) + sum(math.log10(p3(*c[i - 2:i + 1])) for i in range(2, len(c)))
        score += sum(math.log10(unigram(w) / rare) for w in line if group(w) is None)
        out.append((len(line), sum(count[w] > 0 for w in line), total, sum(math.log10(unigram(w)) for w in line), score))
    return out, p1, p3, [*top, "</s>", None]


@pytest.mark.parametrize("classes, shard, cut", [(3, 64 << 20, 9), (100, 20, 9), (100, 500, 0)])
def test_scores_equal_the_formulas(spark, monkeypatch, classes, shard, cut):
    monkeypatch.setattr(L, "CLASSES", classes)
    monkeypatch.setattr(L, "CUT_FILES", cut)
    monkeypatch.setattr(L, "SHARD_BYTES", shard)
    texts = TEXTS + [" ".join(f"w{i % 7} the cat" for i in range(300))]
    learn = [i not in (6, 7) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean")
    docs = docs.withColumns({"shard": F.lit(1), "file": F.lit("x")}).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in L.score_texts(docs, F.col("learn")).collect()}
    want, p1, p3, alphabet = plain(texts, learn, classes)
    for i, row in enumerate(want):
        assert got[i][:3] == row[:3] and got[i][3:] == pytest.approx(row[3:], rel=1e-9)
    assert sum(map(p1, alphabet)) == pytest.approx(1) and sum(p3("the", "cat", x) for x in alphabet) == pytest.approx(1)


def test_lanes_do_not_matter(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 6, n) for n in (0, 1, 2, 3, 50, 700)]
    pairs, triples = zip(*(L.class_grams(t) for t in texts))
    p, pc = np.unique(np.concatenate(pairs), return_counts=True)
    t, tc = np.unique(np.concatenate(triples), return_counts=True)
    keep = rng.random(len(t)) < 0.5
    counts = np.array([6.0, 200, 150, 150, 150, 106])
    automaton = L.Automaton(p, pc, t[keep], tc[keep], counts, counts / counts.sum())
    results = []
    for lane in (1, 7, 256, 10_000):
        monkeypatch.setattr(L, "LANE", lane)
        results.append(automaton.read(texts))
    for other in results[1:]:
        assert np.allclose(results[0], other, rtol=1e-12)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    got = L.score_texts(docs, F.lit(False)).collect()
    assert len(got) == 4 and all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0, 0) for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 2]
    assert L.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert L.score_texts(docs, F.lit(None).cast("boolean")).first()["train_tokens"] == 0


def test_words_of_other_texts_are_better_predicted_than_by_frequency(spark):
    from tamhis.llm.queries import op8_language_model_scoring

    got = op8_language_model_scoring(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert (got.score > got.base_score).mean() > 0.9


@pytest.mark.parametrize("part, line", [(1 << 20, 1 << 19), (50, 7)])
def test_rare_words_have_ngrams_of_their_own(spark, monkeypatch, part, line):
    monkeypatch.setattr(L, "PART_WORDS", part)
    monkeypatch.setattr(L, "LINE_WORDS", line)
    monkeypatch.setattr(L, "SHARD_BYTES", 4000)
    frequent = " ".join(f"w{i} w{i}" for i in range(1500))
    texts = [frequent, *["rare pair here"] * 2, "rare pair here", "here pair rare", "rare", " ".join(f"r{i % 40}" for i in range(200))]
    learn = [True, True, True, False, False, True, True]
    docs = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean")
    got = {r.doc_id: tuple(r)[1:] for r in L.score_texts(docs.repartition(3), F.col("learn")).collect()}
    want = plain(texts, learn, 10**9)[0]
    for i, row in enumerate(want):
        assert got[i][:3] == row[:3] and got[i][3:] == pytest.approx(row[3:], rel=1e-9)
    assert got[3][4] > got[4][4] + 0.1  # the same words in an order that was seen


def folder_bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_counts_are_written_in_less_than_the_texts(spark):
    from pathlib import Path

    from tamhis.workspace import shared_dir

    rng = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(20_000)])
    texts = [" ".join(words[(rng.pareto(1.0, 400) * 5).astype(int) % len(words)]) for _ in range(1_500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = folder_bytes(folder)
    assert L.score_texts(docs, F.col("doc_id") % 5 != 1).count() == len(texts)
    assert 0 < folder_bytes(folder) - before < 0.3 * sum(map(len, texts))  # 0.4 with the hashes in the answers


def test_shuffles_are_released_only_within(spark):
    from tamhis.workspace import shuffles_released

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), shuffles_released(spark):
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("shard", [1000, 16 << 20])
def test_frequent_words_lean_on_their_followers(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD_BYTES", shard)
    texts = [" ".join(f"the n{i}" for i in range(k, k + 450)) for k in range(0, 400, 50)] + ["the n3 the n4", "the zebra the n900", "", None]
    learn = [i not in (3, 9) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r.score for r in L.score_texts(docs.repartition(4), F.col("learn")).collect()}
    lines = [["</s>", *(t or "").split(), "</s>"] for t in texts]
    known = [x for x, u in zip(lines, learn) if u]
    count, grams = Counter(w for x in known for w in x[1:]), Counter(g for x in known for n in (2, 3) for g in zip(*(x[k:] for k in range(n))))
    followers = Counter(g[0] for g in grams if len(g) == 2)
    assert followers["the"] > 600
    scale = count.total() + 0.5 * (len(count) + 1)

    def p2(a, x):
        m = max(300, followers[a])
        return (grams[a, x] + m * (count[x] + 0.5) / scale) / (count[a] + m)

    def p3(a, b, x):
        m = max(300, min(grams[a, b], followers[b]))
        return (grams[a, b, x] + m * p2(b, x)) / (grams[a, b] + m)

    for i, x in enumerate(lines):
        want = math.log10(p2(*x[:2])) + sum(math.log10(p3(*x[k - 2:k + 1])) for k in range(2, len(x)))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_sums_over_shards():
    asked = [(7, [3, 5, 9], [2, 0, 1]), (8, [5, 9], [0, 4]), (9, [11], [6]), (10, [2, 12], [0, 0])]
    rows = [L._asks(s, np.array(k, np.uint64), np.array(n), 1) for s, k, n in asked]
    got = {r["shard"]: r for r in L._answer(L.pa.concat_tables(rows)).to_pylist()}
    settled = {s: L._settled(L._unpack(got[s]["answers"]).astype(np.int64), np.array(n)) for s, _, n in asked}
    assert {s: x[0].tolist() for s, x in settled.items()} == {7: [2, 0, 5], 8: [0, 5], 9: [6], 10: [0, 0]}
    assert sum(r["owned"] for r in got.values()) == 13 and sum(r["distinct"] for r in got.values()) == 3
    assert sum(int(x[1].sum()) for x in settled.values()) == 3
    assert L._asks(1, np.empty(0, np.uint64), np.empty(0, np.int64), 64).num_rows == 0


def test_texts_without_words(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None), (None, " ")], "doc_id string, text string")
    got = L.score_texts(docs, F.lit(True)).collect()
    assert sorted((r.doc_id or "", r.n_tokens, r.n_known, r.train_tokens) for r in got) == [("", 1, 1, 3), ("a", 1, 1, 3), ("b", 1, 1, 3)]
    p = 3.5 / 4
    assert all(r.base_score == pytest.approx(math.log10(p)) and r.score == pytest.approx(math.log10((3 + 300 * p) / 303)) for r in got)
