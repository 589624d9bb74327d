import random

import public_tokenizers
import pytest

from tamhis.llm.token_counts import LongestMatch, count_tokens, read_pieces


def greedy(word, pieces):
    """Take the longest piece again and again."""
    n = at = 0
    while at < len(word):
        length = max((k for k in range(1, len(word) - at + 1) if word[at:at + k] in pieces), default=0)
        if not length:
            return 1
        at += length
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_greedy_matching(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
    automaton = LongestMatch(sorted(pieces))
    for _ in range(2000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_public_vocabulary():
    pieces = read_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    automaton, known = LongestMatch(pieces), set(pieces)
    assert len(pieces) == 50256 and all(bytes([b]) in known for b in range(256))
    for word in (" the", " internationalization", " élan", " \U0001f600", " " + "x" * 300):
        assert automaton.count(word.encode()) == greedy(word.encode(), known)


def test_edges_and_clashing_columns(spark):
    pieces = [b" a", b"b", b"ab", b" "]
    rows = [(1, "a ab  abb\n"), (2, None), (3, ""), (4, " \t "), (5, "zz"), (1, "a ab  abb\n"), (None, "a" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS text_bytes")
    got = count_tokens(docs, pieces, keep=("doc_id", "text_bytes", "n_tokens"))
    assert got.columns == ["doc_id", "text_bytes", "n_bytes", "n_words", "n_tokens"]
    found = {(r.doc_id, r.n_words, r.n_tokens) for r in got.collect()}
    assert found == {(1, 3, 1 + 2 + 3), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1), (None, 1, 1)} and got.count() == 7
    assert count_tokens(docs.limit(0), pieces).count() == 0
