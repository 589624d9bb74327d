"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie with failure links. A node's link leads to the node reached after the longest
pieces at the front of its string are taken off, and its pop count says how many pieces that were. Reading a
word is then one pass over its bytes: follow children, and where there is none, add the pop count and follow
the link. The result equals taking the longest piece of the vocabulary again and again.
"""

import json
import os
from collections import deque
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamhis.llm.common import Growing, Numbering, kept, map_texts

#: Largest vocabulary file that is read and sent to the executors.
VOCABULARY_BYTES = 64 << 20
#: Distinct words whose counts a Python worker keeps.
WORDS = 1_000_000
WORD_START = b" "


def byte_letters() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies spell their pieces."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file (JSON), special tokens left out; a space starts a word."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content.get("added_tokens", ())}
    letters = byte_letters()
    return [bytes(letters[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special]


class LongestMatch:
    """The automaton: ``count(word)`` is the number of greedy longest pieces of a byte string."""

    def __init__(self, pieces: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    final.append(False)
            final[node] = node != 0
        self.link, self.pops = [-1] * len(final), [0] * len(final)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for byte, child in self.children[node].items():
                if final[child]:
                    self.link[child], self.pops[child] = 0, 1
                else:
                    self._inherit(node, byte, child)
                todo.append(child)

    def _inherit(self, node: int, byte: int, child: int) -> None:
        at, popped = self.link[node], self.pops[node]
        while at >= 0 and byte not in self.children[at]:
            popped += self.pops[at]
            at = self.link[at]
        if at >= 0:
            self.link[child], self.pops[child] = self.children[at][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 (one unknown token) if it cannot be spelled, 0 if it is empty."""
        children, link, pops = self.children, self.link, self.pops
        node = total = 0
        for byte in word:
            while (child := children[node].get(byte)) is None:
                if link[node] < 0:
                    return 1
                total += pops[node]
                node = link[node]
            node = child
        while node:
            if link[node] < 0:
                return 1
            total += pops[node]
            node = link[node]
        return total


def count_tokens(docs: DataFrame, pieces: Iterable[bytes], text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, n_words, n_tokens (long) of every whole text.

    Words are runs of anything but ASCII white space, each read with a leading space, so that only pieces that
    start a word match at its start. A null or blank text has no words and no tokens. Rows are independent:
    ties, repeated rows and an empty table need no rule. Each distinct word is read once per (bounded) table of a
    task. The vocabulary is broadcast; ``read_pieces`` bounds its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))

    def table():
        counts = Growing(np.int64)
        automaton = LongestMatch(shared.value)
        return counts, Numbering(lambda w: counts.append(automaton.count(WORD_START + w)), counts.clear, WORDS)

    def start():
        counts, words = kept("token counts", hash(tuple(shared.value)), table)

        def compute(texts):
            rows = []
            for t in texts:
                found = t.split() if t else []
                words.trim()
                numbers = words.numbers(found)
                rows.append((len(t or b""), len(found), int(counts.values[numbers].sum())))
            return list(zip(*rows))

        return compute

    return map_texts(docs, text, keep, [(n, T.LongType()) for n in ("n_bytes", "n_words", "n_tokens")], start)
