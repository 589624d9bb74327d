import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamhis.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's the 'll  don't\x1cnow\x85x  y \xa0z é ́a H̱ Hx̱ <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
       "ΑΣ Σ. Å İstanbul ﬁ\x0b\x0cq 12 3.4 k \U0001f600‍\U0001f44d ＡＢ ½", "", " \n", "́", "A" * 3000, "x" * 50 + "　日本語 テキスト"]


@pytest.mark.parametrize("limit", [P.CHUNKS, 3])
def test_cached_ids_equal_whole_texts(limit):
    content = P.read_tokenizer(PATH)
    encoder, plain = P.Encoder(content, limit), Tokenizer.from_str(content)
    for texts in (ODD, ODD[::-1], ODD[:2]):
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


def test_deal_goes_to_the_cheapest_sequence_with_room():
    assert P.deal([5, 3, 2], [5, 5]) == [(0, 0, 5, 0, 0), (1, 0, 3, 1, 0), (2, 0, 2, 1, 3)]
    cut = P.deal([6, 6, 4], [8, 8])
    assert sorted((i, s, n) for i, s, n, _, _ in cut) == [(0, 0, 6), (1, 0, 6), (2, 0, 2), (2, 2, 2)]
    assert P.tail_sizes(0) == [] and P.tail_sizes(1300) == [1024, 256, 16, 4]


@pytest.mark.parametrize("group", [P.GROUP_SEQUENCES, 2])
def test_every_id_is_packed_once(spark, monkeypatch, group):
    monkeypatch.setattr(P, "GROUP_SEQUENCES", group)
    rng = np.random.default_rng(0)
    rows = [(int(i), " ".join(rng.choice(["the", "cat's", "über", "3.5", "xyzzy"], int(n)))) for i, n in
            enumerate(rng.lognormal(4, 1.4, 150))]
    rows += [(500, None), (501, ""), (502, "long words " * 9000), (7, rows[7][1]), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS bytes_doc_id").coalesce(2)
    pieces = P.pack(docs, P.read_tokenizer(PATH), capacity=64 * 4).collect()
    plain = Tokenizer.from_file(PATH)
    fill, by_doc = {}, {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 256  # full, or a shorter power of two: no padding
    assert sum(sum(n for _, n in parts) != 256 for parts in fill.values()) <= 2 * 8
    for key, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(by_doc[key], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) * sum(r[0] == key for r in rows)
        for p in own:
            assert p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
        assert {s for p in own for s in range(p.start, p.start + p.length)} == set(range(len(ids)))
    assert P.pack(docs.limit(0), P.read_tokenizer(PATH)).count() == 0


def test_words_are_numbered_in_one_pass():
    """A known word costs one look-up; a new one is listed once, by its number, until it is learnt."""
    numbers = P.Numbers()
    assert [numbers[w] for w in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1] and numbers.new == [b"a", b"b", b"c"]
    numbers.new = []
    assert [numbers[w] for w in (b"c", b"d")] == [2, 3] and numbers.new == [b"d"]
