import random

import numpy as np
import pytest
import xxhash

from tamhis.llm import simhash as S


def plain(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(0)
    for n in [0, 1, 2, 3, 4, 50, 3000]:
        text = " ".join(rng.choice(["Der", "é", "THE", "x\x85y", "a", "ẞ"]) for _ in range(n)) + " \n"
        assert S.fingerprint(text.encode()) == plain(text)
    assert S.fingerprint(None) == S.fingerprint(b" \t") == 0


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('der the é')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("der the é", 42)


def test_the_code_is_perfect_and_keys_meet():
    code, rng = S.Golay(), np.random.default_rng(0)
    assert len(set(code.errors.tolist())) == 2048
    words = rng.integers(0, 1 << 23, 4000)
    for _ in range(4):
        other = words.copy()
        for _ in range(2):
            other ^= 1 << rng.integers(0, 23, len(words))
        a, b = ({*zip(*(x.tolist() for x in code.fuzzy(w)))} for w in (words, other))
        assert {r for r, _ in a & b} == set(range(len(words)))
    rows, _ = code.fuzzy(words)
    assert set(np.bincount(rows).tolist()) == {1, 6}


def groups(fps, max_bits=2):
    """Smallest reachable fingerprint of each, by comparing all pairs."""
    part = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= max_bits and part[b] < part[a]:
                    part[a], changed = part[b], True
    return part


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("key_rows", [64, 2])  # 2: nearly all links go through midpoints
def test_links_span_the_same_groups(spark, monkeypatch, max_bits, key_rows):
    monkeypatch.setattr(S, "KEY_ROWS", key_rows)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(rng.randint(0, 3)):
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps += [fps[0] ^ (1 << b) for b in range(0, 60, 3)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = S.links(table, max_bits)
    pairs = {(r.a, r.b) for r in linked.collect()}
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= max(max_bits, 0) for a, b in pairs)
    got = {f: f for f in signed} | {r.node: r.component for r in S.connected_components(linked).collect()}
    want = groups([f % (1 << 64) for f in signed], max_bits)
    assert len(set(got.values())) == len(set(want.values()))
    by_got, by_want = {}, {}
    for f in signed:
        by_got.setdefault(got[f], set()).add(f)
        by_want.setdefault(want[f % (1 << 64)], set()).add(f)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " extra"), (7, "something else altogether here"), (8, None), (2, ""),
            (4, "  "), (None, "lonely text of its own"), (3, base), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own_key", "2 AS component_id", "3 AS fp")
    got = S.near_duplicates(docs, keep=docs.columns)
    assert got.columns == ["doc_id", "text", "own_key", "fp", "fingerprint_bits", "component_id"]
    parts = [(r.doc_id, r.component_id) for r in got.collect()]
    want = {5: 3, 3: 3, 7: 7, 8: 2, 2: 2, 4: 2}
    assert len(parts) == len(rows) and all(want[d] == c for d, c in parts if d in want)
    close = bin(S.fingerprint(base.encode()) ^ S.fingerprint((base + " extra").encode())).count("1") <= 2
    assert dict(parts)[9] == (3 if close else 9)
    assert sorted([c for d, c in parts if d is None], key=str) == [3, None]
    assert S.near_duplicates(docs.limit(0)).count() == 0
