"""SimHash fingerprints and near-duplicate groups through Golay-code fuzzy keys.

A fingerprint is cut into three segments, each a word of the binary Golay code's 23 bits. The code is
perfect: every word lies within three bits of exactly one codeword. The fuzzy keys of a word are the codewords
that it and its one-bit neighbours decode to (one or six of them); two words at most two bits apart
have a common neighbour, hence a common key. Two fingerprints at most two bits apart agree in at least one
whole segment and differ by at most two bits in the next one, so they share an (exact segment, fuzzy
key) pair: at most 18 keys per fingerprint find every link.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import col, fresh, join_classes, map_texts
from tamhis.llm.components import connected_components
from tamhis.workspace import written

SEED = 42
MAX_BITS = 2
#: (first bit, width) of the segments; each is padded with zeros to 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are joined with each other; larger keys go the way of ``_midpoint_links``.
KEY_ROWS = 64


# -- fingerprints ---------------------------------------------------------------------------------

def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of a text: XXH64 (seed 42) of every shingle, a bit set if over half of them set it.

    A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    begin = np.concatenate([[0], ends[: len(found) - words]]).tolist()
    stop = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(begin)
    for k in range(0, n, 65536):
        h = np.array([digest(line[i:j], SEED) for i, j in zip(begin[k:k + 65536], stop[k:k + 65536])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def with_fingerprints(docs: DataFrame, out: str, text: str, keep, words: int) -> DataFrame:
    """``keep`` columns and the fingerprint of every whole text as a (signed) long."""
    def start():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, text, keep, [(out, T.LongType())], start)


# -- Golay keys -----------------------------------------------------------------------------------

class Golay:
    """Decoder of the binary [23, 12] code from its generator polynomial."""

    POLYNOMIAL = 0b110001110101

    def __init__(self):
        unit = []
        for bit in range(23):
            rest = 1 << bit
            for top in range(22, 10, -1):
                if rest >> top & 1:
                    rest ^= self.POLYNOMIAL << (top - 11)
            unit.append(rest)
        self.syndromes = [self._sums(unit[:12]), self._sums(unit[12:])]
        self.errors = np.zeros(2048, np.int64)  # perfect code: every syndrome has one pattern of up to three bits
        single = [(1 << i, unit[i]) for i in range(23)]
        known = [(0, 0)]
        for _ in range(3):
            known += [(e | f, s ^ t) for e, s in known for f, t in single if f > e]
        for e, s in known:
            self.errors[s] = e

    @staticmethod
    def _sums(unit):
        out = np.zeros(1, np.int64)
        for u in unit:
            out = np.concatenate([out, out ^ u])
        return out

    def index(self, words: np.ndarray) -> np.ndarray:
        """Number of the nearest codeword (12 bits)."""
        s = self.syndromes[0][words & 0xFFF] ^ self.syndromes[1][words >> 12]
        return (words ^ self.errors[s]) >> 11

    def fuzzy(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and codeword numbers: for each word, those that words within one bit decode to."""
        near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
        found = np.sort(self.index(near), axis=1)
        new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        rows, at = np.nonzero(new)
        return rows, found[rows, at]


def golay_keys(fingerprints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys (36 bits: choice of segments, exact segment, fuzzy key of the next)."""
    value = fingerprints.view(np.uint64)
    parts = [((value >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        r, index = code.fuzzy(parts[(i + 1) % 3])
        rows.append(r)
        keys.append(i << 34 | parts[i][r] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches):
    code = Golay()
    for batch in batches:
        for k in range(0, batch.num_rows, 8192):
            own = np.asarray(batch.column(0).slice(k, 8192), np.int64)
            rows, keys = golay_keys(own, code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], ["key", "fp"])


# -- links and groups -----------------------------------------------------------------------------

def _midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints of crowded keys, without comparing them pair by pair.

    Two different fingerprints are at most two bits apart if and only if some value is at most one bit from both.
    Each gives its 65 such values; a value has at most 65 different fingerprints around it, whatever the
    data, and all of them are linked to the smallest.
    """
    near = fps.select("fp", F.explode(F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("mid"))
    groups = near.groupBy("mid").agg(F.collect_set("fp").alias("around")).filter(F.size("around") > 1)
    pairs = groups.select(F.explode("around").alias("a"), F.array_min("around").alias("b")).filter("a != b")
    if max_bits == MAX_BITS:
        return pairs
    # one bit: the middle value is itself one of the two
    return near.filter("mid != fp").select(F.col("fp").alias("a"), F.col("mid").alias("b")).join(
        fps.select(F.col("fp").alias("b")), "b").select("a", "b")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that span the same groups as all links among the distinct fingerprints ``fp`` (long).

    Keys of one fingerprint are dropped after a pre-aggregated count; keys of up to ``KEY_ROWS`` are joined and
    verified; the fingerprints of larger ones are linked through midpoints, also exactly.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the code's keys cover distances of at most two bits")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = written(fps.mapInArrow(_emit_keys, "key long, fp long"), "golay-keys")
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(keyed.join(crowd, "key"), "shared-keys")
    small = shared.filter(F.col("n") <= KEY_ROWS)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    joined = left.join(right, "key").filter(
        (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    crowded = shared.filter(F.col("n") > KEY_ROWS).select("fp").distinct()
    return joined.union(_midpoint_links(crowded, max_bits).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, key: str = "doc_id",
                    text: str = "text", keep=("doc_id",), fingerprint_col: str = "fingerprint_bits",
                    component_col: str = "component_id", group_col: str | None = None) -> DataFrame:
    """``keep`` columns, the fingerprint (long) and the component (smallest ``key`` reachable by links).

    Every row takes part. Equal fingerprints are one class, counted before anything is shuffled, so copies
    cost nothing; null and blank texts have fingerprint 0 and are linked like any other; a class all of whose
    keys are null has a null component. Repeated rows get the same component. An empty table gives no
    rows. With ``group_col``, a column of that name holds the smallest fingerprint reachable by links, which names the
    component whatever the keys are. Input columns named like the result columns are left out.
    """
    made = [fingerprint_col, component_col, *([group_col] if group_col else [])]
    keep = [c for c in keep if c.lower() not in [m.lower() for m in made]]
    own = fresh("own_key", [*keep, *made])
    marked = with_fingerprints(docs.withColumn(own, col(key)), fingerprint_col, text, [*keep, own], words)
    marked = written(marked, "fingerprints")
    fp = col(fingerprint_col)
    classes = written(marked.groupBy(fp.alias("fp")).agg(F.min(col(own)).alias("least"), F.count("*").alias("size")), "classes")
    parts = connected_components(links(classes.select("fp"), max_bits))
    named = classes.join(parts, classes["fp"] == parts["node"]).select("fp", "least", "component")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = named.join(smallest, "component").select("fp", "smallest", "component")
    size = fresh("size", [*marked.columns, *made])
    of = written(classes.join(linked, "fp", "left").select(
        F.col("fp").alias(fingerprint_col), F.coalesce("smallest", "least").alias(component_col),
        *([F.coalesce("component", "fp").alias(group_col)] if group_col else []), F.col("size").alias(size)), "components")
    found = join_classes(marked, of, [fingerprint_col], size)
    return found.select(*[col(c) for c in keep], *[col(c) for c in made])
