import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tamhis.llm import byte_bpe as B
from tamhis.llm.queries import QUERIES

RANKS = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.parse(RANKS), special_tokens={})
ODD = [
    "", " ", "\n \n\n  x", "a" * 5000, "-" * 1001, " " * 700 + "b", "l'été d'Élan \U0001f600‍\U0001f600", "\x00\x01\x1c\x85  z",
    "<|endoftext|> it's WE'LL 12٣4 ́e", "".join(random.Random(1).choice("abcdefgh é") for _ in range(400)),
    "".join(random.Random(2).choice("etaoinshrdlu") for _ in range(1500)), "word " * 3000,
]


def encoded(texts, at_once=True, content=RANKS):
    ids, sizes, raw, lengths = B.Encoder(content, public_tokenizers.PATTERN, at_once, True).encode([t.encode() for t in texts])
    assert [x.tobytes() for x in np.split(raw, np.cumsum(lengths)[:-1])] == [t.encode() for t in texts]
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_equals_the_library():
    assert encoded(ODD) == [OWN.encode_ordinary(t) for t in ODD]
    short = [t[:200] for t in ODD]
    assert encoded(short, at_once=False) == [OWN.encode_ordinary(t) for t in short]


def test_every_character_is_split_as_by_the_library():
    step = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}" for c in range(0, 0x11000, 7) if not 0xD800 <= c < 0xE000]
    assert encoded(step) == [OWN.encode_ordinary(t) for t in step]


@pytest.mark.parametrize("seed", range(8))
def test_any_ranks(seed):
    """Vocabularies at random, most of them not orderly, one contraction after the other."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    extra = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
    order = [*sorted(tokens), *rng.sample(sorted(extra), len(extra))]
    ranks = {t: i for i, t in enumerate(order)}
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]

    def plain(word):
        if word in ranks:
            return [ranks[word]]
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    content = b"\n".join(__import__("base64").b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    assert encoded(texts, B.orderly(ranks), content) == [plain(t.encode()) if t else [] for t in texts]


def test_orderly():
    base = {bytes([b]): b for b in range(256)}
    assert B.orderly(B.parse(RANKS)) and B.orderly(base | {b"ab": 256, b"abc": 257})
    assert not B.orderly(base | {b"abc": 256, b"ab": 257}) and not B.orderly(base | {b"abc": 256})


def test_edges_and_round_trip(spark):
    texts = [*ODD, None, "again", "again"]
    rows = [(i if t != "again" else 7, t, 5, "x") for i, t in enumerate(texts)] + [(None, "no key", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, text_bytes string")
    both = B.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded")
    out = B.decode(B.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert both.columns == out.columns and sorted(map(str, both.collect())) == sorted(map(str, out.collect()))
    assert out.columns == ["doc_id", "text", "text_bytes", "ids", "decoded"]
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.ids == OWN.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert B.digest(B.decode(B.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS)).count() == 0
    odd = spark.createDataFrame([(1, [0, 10 ** 6]), (2, None), (3, []), (4, [None, 1]), (5, [-1]), (6, [64] * 300)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in B.decode(odd, RANKS).collect()} == {1: None, 2: None, 3: b"", 4: None, 5: None, 6: b"a" * 300}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts) == 1000
    for r in got:
        ids = OWN.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
