import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from check_oracle import connect, same
from tamhis.llm import decontamination, packing, quality, simhash, toxicity
from tamhis.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_registry():
    names = entry.queries()
    assert [len([n for n in names if re.match(rf"op{k}_", n)]) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_sql(spark, key):
    for sf in ("/root/testdata/sf0.001", SF):
        assert same(QUERIES[key](spark, sf), connect(sf), ORACLE_SQL[key]) == ""


@pytest.fixture(scope="module")
def stages(spark):
    """Documents after each stage, with rows that any stage must survive added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.filter("doc_id in (1, 2, 4)").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat(text, ' tail of its own ', doc_id) AS text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0)], docs.schema)
    first = docs.union(clean).union(odd).union(docs.filter("doc_id = 1"))
    out = [first]
    for _, stage in C.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_return_documents(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "decontamination", "packing"]
    for df in stages[1:5]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()
    sizes = [df.count() for df in stages[:5]]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] > sizes[3] > sizes[4] > 300


def test_each_stage_applies_its_operator(spark, stages):
    rows = [sorted(map(tuple, df.collect()), key=str) for df in stages[:5]]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(stages[0], toxicity.fit(stages[0], labels), keep=stages[0].columns, out="tox")
    assert sorted((tuple(r)[:5] for r in scored.filter("tox < 0.5").collect()), key=str) == rows[1]
    scored = quality.score(stages[1], quality.fit(stages[1], labels), keep=stages[1].columns, out="good")
    assert sorted((tuple(r)[:5] for r in scored.filter("good >= 0.5").collect()), key=str) == rows[2]
    # near duplicates by comparing all fingerprints
    prints = [(simhash.fingerprint((r[1] or "").encode()), r) for r in rows[2]]
    part = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (a, _) in enumerate(prints):
            for j in range(i):
                if bin(a ^ prints[j][0]).count("1") <= 2 and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    kept = {}
    for p, (_, r) in zip(part, prints):
        kept[p] = min(kept.get(p, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert sorted((str(r[0]) for r in kept.values())) == sorted(str(r[0]) for r in rows[3])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontamination.overlaps(stages[3], bench).collect()}
    assert hit and [r for r in rows[3] if r[0] not in hit] == rows[4]
    items = [r.text for r in bench.collect()]
    assert not [r for r in rows[4] if r[1] and any(t in r[1] for t in items)]


def test_packing_covers_what_was_kept(stages):
    pieces, last = stages[5].collect(), stages[4].collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert set(tokens) == {r.doc_id for r in last}
    whole = {p.doc_id: p.doc_tokens for p in pieces if p.doc_id is not None}
    assert all(tokens[k] == n for k, n in whole.items())
    assert max(p.offset + p.length for p in pieces) <= packing.CAPACITY


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0 and C.ORACLE_SQL is None


def test_groups_of_near_copies_do_not_depend_on_ids(spark):
    base, near = [f"w{i}" for i in range(400)], None
    for i in range(400):  # a copy one or two bits away
        text = " ".join([*base[:i], "other", *base[i + 1:]])
        if 1 <= (simhash.fingerprint(text.encode()) ^ simhash.fingerprint(" ".join(base).encode())).bit_count() <= 2:
            near = text
            break
    rows = [(7, "one text of its own about ships"), (7, "quite another one on the growing of apples"), (None, " ".join(base)), (None, near)]
    assert near
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = C.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.text for r in kept if r.doc_id == 7) == sorted(t for _, t in rows[:2])
    assert len([r for r in kept if r.doc_id is None]) == 1
