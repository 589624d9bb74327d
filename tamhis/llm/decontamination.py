"""Benchmark decontamination: spaced-seed hashes, then verified overlaps that tolerate substitutions.

Texts become sequences of word hashes. A mask reads some positions of a window and ignores the others, so a hit survives
substitutions at ignored positions. Hits between a document and a benchmark item lie on a diagonal; along it
matches are counted, and the longest stretch around the hit in which a given share of the words match is the
overlap. It counts if it is long enough.
"""

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import Growing, Numbering, col, fresh, map_texts, text_slices

#: Windows of 12 words whose positions form four groups of three. A mask reads two groups and ignores the other six
#: positions; any two positions lie within some two groups, so any two substitutions leave a mask whole.
GROUPS = "abcdbacddcab"
MASKS = [tuple(i for i, g in enumerate(GROUPS) if g in pair) for pair in combinations("abcd", 2)]
#: An overlap has so many words (a shorter item: all of it), and so many of them match.
MIN_WORDS, SHARE = 13, 0.8
#: Items of fewer words than this are too short to be told from chance.
SHORTEST = 5
#: Benchmark text that is broadcast at a time; more is worked off block by block.
BLOCK_BYTES = 16 << 20
TABLE_BITS = 20
_STRIP = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_MIX = np.random.default_rng(7).integers(1 << 62, (1 << 63) - 1, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_hash(word: bytes) -> int:
    """XXH64 of a word without punctuation at its ends, in lower case; 0 for one that is only punctuation."""
    w = word.strip(_STRIP).decode("utf-8", "replace").lower()
    return (xxhash.xxh64_intdigest(w) or 1) if w else 0


class Hasher:
    """Texts -> arrays of word hashes, punctuation-only words left out."""

    def __init__(self):
        self.hashes = Growing(np.uint64)
        self.words = Numbering(lambda w: self.hashes.append(word_hash(w)), self.hashes.clear)

    def __call__(self, text: bytes | None) -> np.ndarray:
        self.words.trim()
        numbers = self.words.numbers(text.split()) if text else np.empty(0, np.int64)
        found = self.hashes.values[numbers]
        return found[found != 0]


def seeds(hashes: np.ndarray, mask: Sequence[int]) -> np.ndarray:
    """The seed hash of every window."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, _MIX[0], np.uint64)
    for k, at in enumerate(mask):
        out = (out ^ hashes[at:at + n]) * _MIX[k + 1]
        out ^= out >> np.uint64(29)
    return out


def masks_for(words: int) -> list[tuple[int, ...]]:
    """Positions read in an item of so many words. One too short for the masks has three of its own length, each of which
    ignores every third word, so that any one substitution leaves a mask whole."""
    if words < SHORTEST:
        return []
    if words < len(GROUPS):
        return [tuple(i for i in range(words) if i % 3 != k) for k in range(3)]
    return MASKS


class Items:
    """Benchmark items and their seeds, by mask."""

    def __init__(self, keys: list, texts: list):
        hasher = Hasher()
        self.keys, self.words = keys, [hasher(t) for t in texts]
        tables: dict[tuple[int, ...], list] = {}
        for item, words in enumerate(self.words):
            for mask in masks_for(len(words)):
                found = seeds(words, mask)
                tables.setdefault(mask, []).append((found, np.full(len(found), item), np.arange(len(found))))
        self.tables = []
        for mask, parts in tables.items():
            seed, item, at = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(seed, kind="stable")
            present = np.zeros(1 << TABLE_BITS, bool)
            present[seed >> np.uint64(64 - TABLE_BITS)] = True
            self.tables.append((mask, seed[order], item[order], at[order], present))

    def hits(self, line: np.ndarray):
        """(position in the line, item, position in the item, length of the mask) of all equal seeds."""
        for mask, seed, item, at, present in self.tables:
            own = seeds(line, mask)
            maybe = np.nonzero(present[own >> np.uint64(64 - TABLE_BITS)])[0]
            low = np.searchsorted(seed, own[maybe], "left")
            size = np.searchsorted(seed, own[maybe], "right") - low
            spots = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield np.repeat(maybe, size), item[spots], at[spots], mask[-1] + 1


def overlap(matches: np.ndarray, begin: int, stop: int, share: float) -> tuple[int, int]:
    """The longest stretch around [begin, stop) in which at least ``share`` of the entries match."""
    gain = np.concatenate([[0.0], np.cumsum(matches - share)])
    tops = np.maximum.accumulate(gain[::-1])[::-1]  # largest gain from here to the end
    best = (0, 0)
    for i in np.nonzero(gain[:begin + 1] <= tops[stop] + 1e-9)[0]:
        j = int(np.nonzero(gain >= gain[i] - 1e-9)[0][-1])
        if j >= stop and j - i > best[1] - best[0]:
            best = (int(i), j)
        if j - i >= len(matches) - i:
            break  # no later start can give a longer one
    return best


def verify(doc: np.ndarray, hits, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the document, start in the item, words, matching words) of the accepted overlaps."""
    out, covered = set(), {}
    for at, item, pos, width in sorted(hits, key=lambda h: (h[1], h[0] - h[2], h[0])):
        diagonal = at - pos
        if at < covered.get((item, diagonal), -1):
            continue  # inside an overlap that has been looked at
        words = items.words[item]
        first, last = max(0, -diagonal), min(len(words), len(doc) - diagonal)
        matches = doc[first + diagonal: last + diagonal] == words[first:last]
        i, j = overlap(matches, pos - first, min(pos - first + width, len(matches)), SHARE)
        covered[item, diagonal] = first + diagonal + j
        if j - i >= min(MIN_WORDS, len(words)):
            out.add((item, first + diagonal + i, first + i, j - i, int(matches[i:j].sum())))
    return sorted(out)


class Finder:
    """Overlaps of texts with a block of items; the words of many texts are hashed in one array."""

    def __init__(self, items: Items):
        self.items, self.hasher = items, Hasher()

    def __call__(self, texts: list) -> list[list[tuple[int, int, int, int, int]]]:
        words = [self.hasher(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        line = np.concatenate(words) if words else np.empty(0, np.uint64)
        hits = [[] for _ in texts]
        for at, item, pos, width in self.items.hits(line):
            owner = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[owner]
            for o, a, i, p in zip(owner[inside].tolist(), at[inside].tolist(), item[inside].tolist(), pos[inside].tolist()):
                hits[o].append((a - (ends[o] - len(words[o])), i, p, width))
        return [verify(w, h, self.items) if h else [] for w, h in zip(words, hits)]


def blocks(benchmark: DataFrame, key: str, text: str):
    """Broadcast blocks of items of about ``BLOCK_BYTES``, told apart by a hash of their text."""
    narrow = benchmark.select(col(key).alias("key"), col(text).cast("string").cast("binary").alias("t")).dropna(subset=["t"])
    size = narrow.agg(F.sum(F.length("t"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for b in range(count):
        rows = narrow.filter(F.pmod(F.xxhash64("t"), F.lit(count)) == b).collect()
        rows.sort(key=lambda r: (str(r[0]), bytes(r[1])))
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [bytes(r[1]) for r in rows]))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """One row per accepted overlap: key, item_key, doc_start, item_start, n_words, n_matching (in words).

    Every whole text is read once per benchmark block (one, below ``BLOCK_BYTES`` of items). Null and empty texts
    and items of fewer than ``SHORTEST`` words have no overlap; repeated rows and repeated items each
    give their own rows; an empty benchmark or table gives none. A null key stays null.
    """
    body = fresh("text_bytes", [key])
    narrow = docs.select(col(key).alias(key), col(text).cast("string").cast("binary").alias(body))
    item_type = benchmark.schema[item_key].dataType
    item_out = fresh(item_key, [key])
    numbers = [fresh(n, [key, item_out]) for n in ("doc_start", "item_start", "n_words", "n_matching")]
    schema = T.StructType([narrow.schema.fields[0], T.StructField(item_out, item_type),
                           *[T.StructField(n, T.LongType()) for n in numbers]])
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in blocks(benchmark, item_key, item_text):
        out = out.union(narrow.mapInArrow(_find_in(shared, schema), schema))
    return out


def _find_in(shared, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        find = Finder(shared.value)
        for batch in batches:
            for part in text_slices(batch, 1):
                found = find(part.column(1).to_pylist())
                keys = part.column(0).to_pylist()
                rows = [(keys[i], shared.value.keys[o[0]], *o[1:]) for i, own in enumerate(found) for o in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=arrow.names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text has no accepted overlap with any item; see ``overlaps``."""
    columns = docs.columns
    hit = fresh("n_overlaps", columns)
    for shared in blocks(benchmark, item_key, item_text):
        def start(shared=shared):
            find = Finder(shared.value)
            return lambda texts: [[len(x) for x in find(texts)]]

        docs = map_texts(docs, text, columns, [(hit, T.LongType())], start).filter(col(hit) == 0).drop(hit)
    return docs
