"""Ranked lexical search: bundles of items travel past the owners of terms and collect integer scores of documents."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import Growing, col, fresh, started, text_slices
from tamhis.workspace import release, written

#: Documents whose postings and accumulators lie together (their numbers fit 16 bits), and items of a bundle.
SHARD_DOCS, BUNDLE_ITEMS = 8192, 128
#: Postings that a task holds before it closes a shard early.
SHARD_POSTINGS = 4_000_000
#: Stages; each owns the terms of one remainder of their hash.
OWNERS = 4
#: Bits of the filter that tells terms no item has; its size is fixed, whatever the number of items.
FILTER_BITS = 1 << 22
#: Words whose number a task keeps.
WORDS = 500_000

#: A term is a maximal run of bytes that are ASCII letters or digits or not ASCII; only A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, q): how often each term occurs in the different texts of an item."""
    source = items.select(col(item).alias("item"), col(text).cast("string").cast("binary").alias("t")).distinct()
    schema = T.StructType([source.schema["item"], T.StructField("term", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                found = [terms(t) for t in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = pa.array([w for f in found for w in f], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), flat], schema.names)

    return source.mapInArrow(run, schema).groupBy("item", "term").agg(F.count("*").alias("q"))


def _filter(uses: DataFrame) -> bytes:
    """A bit for the hash of every term of an item."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS, bool)
    for row in uses.groupBy(F.floor(bit / 4096).alias("part")).agg(F.collect_set(bit).alias("bits")).toLocalIterator():
        bits[row.bits] = True
    return np.packbits(bits).tobytes()


class _Words(dict):
    """Word -> number in order of first sight, -1 for a word that no item has (as far as the filter tells)."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits, self.names = np.unpackbits(np.frombuffer(bits, np.uint8)), []

    def __missing__(self, word):
        known = self.bits[xxhash.xxh64_intdigest(word, 42) % FILTER_BITS]
        self[word] = n = len(self.names) if known else -1
        if known:
            self.names.append(word)
        return n


def _postings(docs: DataFrame, key: str, text: str, bits: bytes) -> DataFrame:
    """Rows of shards of documents: one without a term that lists the documents, and one per term of an item.

    (shard, term, n, total, keys, body): ``keys`` in ascending order, the document's place in it being its number; ``body``
    has the lengths of the documents (a term: document numbers of 16 bits, then frequencies); ``n`` counts documents with
    a term (with the term), ``total`` their terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    narrow = docs.select(col(key).alias("key"), col(text).cast("string").cast("binary").alias("t"))
    kind = narrow.schema["key"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("body", T.BinaryType())])

    def run(batches):
        words = started(lambda: _Words(shared.value))
        shard = TaskContext.get().partitionId() << 40
        keys, lengths, places, docs_of, counts = [], Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(np.int64)

        def close():
            """The rows of the shard; documents are numbered in the order of their keys."""
            ids = pa.concat_arrays(keys)
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            sizes, which, doc, tf = lengths.values[order], places.values, number[docs_of.values], counts.values
            by = np.lexsort((doc, which))
            which, doc, tf = which[by], doc[by].astype(np.uint16), tf[by]
            starts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
            bodies = [sizes.tobytes()]
            for a, b in zip(starts, [*starts[1:], len(which)]):
                part = tf[a:b]
                width = np.uint8 if part.max() < 256 else np.int64
                bodies.append(doc[a:b].tobytes() + part.astype(width).tobytes())
            n = len(bodies)
            listed = pa.ListArray.from_arrays(
                pa.array([0] + [len(ids)] * n, pa.int32(), mask=np.array([False] + [True] * (n - 1) + [False])), ids.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([
                pa.array([shard] * n, pa.int64()),
                pa.array([None, *[words.names[w] for w in which[starts]]], pa.binary()),
                pa.array([int((sizes > 0).sum()), *np.diff([*starts, len(which)]).tolist()], pa.int64()),
                pa.array([int(sizes.sum())] + [None] * (n - 1), pa.int64()), listed, pa.array(bodies, pa.binary())], schema.names)

        for batch in batches:
            for part in text_slices(batch, 1):
                found = [terms(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(f) for f in found], np.int64)
                flat = np.fromiter((words[w] for f in found for w in f), np.int64, int(sizes.sum()))
                doc = np.repeat(np.arange(lengths.n, lengths.n + len(found)), sizes)[flat >= 0]
                pair, tf = np.unique(flat[flat >= 0] << 32 | doc, return_counts=True)
                places.extend(pair >> 32)
                docs_of.extend(pair & 0xFFFFFFFF)
                counts.extend(tf)
                lengths.extend(sizes)
                keys.append(part.column(0))
                if lengths.n > SHARD_DOCS - 256 or places.n >= SHARD_POSTINGS or len(words) >= WORDS:
                    yield close()
                    shard += 1
                    keys = []
                    for g in (lengths, places, docs_of, counts):
                        g.clear()
                    if len(words) >= WORDS:
                        words.clear()
                        words.names.clear()
        if keys:
            yield close()

    return narrow.mapInArrow(run, schema)


def _pack(scores: np.ndarray) -> bytes:
    """Documents with a score: their distances, then the scores byte plane by byte plane, compressed."""
    docs = np.flatnonzero(scores)
    planes = scores[docs].astype("<i8").view(np.uint8).reshape(-1, 8).T
    raw = np.diff(docs, prepend=0).astype("<u2").tobytes() + planes.tobytes()
    return len(docs).to_bytes(4, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpack(body: bytes, scores: np.ndarray) -> None:
    n = int.from_bytes(body[:4], "little")
    if n:
        raw = pa.decompress(body[4:], 10 * n, "zstd", asbytes=True)
        docs = np.cumsum(np.frombuffer(raw[:2 * n], "<u2"), dtype=np.int64)
        scores[docs] = np.frombuffer(raw[2 * n:], np.uint8).reshape(8, n).T.copy().view("<i8").ravel()


def _visit(bundle: pa.Table, owned: pa.Table, n_docs: int, n_terms: int) -> np.ndarray:
    """The accumulators of a bundle (items, documents) after its visit to an owner of terms."""
    lengths = np.frombuffer(bundle.column("lengths")[0].as_py(), np.int64)
    scores = np.zeros((BUNDLE_ITEMS, len(lengths)), np.int64)
    for slot, body in zip(bundle.column("slots")[0].as_py() or (), bundle.column("scores")[0].as_py() or ()):
        _unpack(body, scores[slot])
    size = 75 + 25 * lengths * n_docs // max(1, n_terms)
    for body, n, weight, uses in zip(*(owned.column(c).to_pylist() for c in ("body", "n", "weight", "uses"))):
        docs = np.frombuffer(body[:2 * n], np.uint16)
        tf = np.frombuffer(body[2 * n:], np.uint8 if len(body) == 3 * n else np.int64).astype(np.int64)
        gain = weight * (1_000_000_000 * tf // (1000 * tf + 12 * size[docs]))
        for use in uses:
            scores[use["slot"], docs] += use["q"] * gain
    return scores


def search(docs: DataFrame, items: DataFrame, k: int = 20, owners: int = OWNERS, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the ``k`` documents of the highest score above 0 for every item, equal scores by ascending key.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. With N documents that
    have a term, L terms in all of them, n terms in a document, df documents that hold a term and tf times that it occurs in
    one, a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document has m = 75 + 25nN div L, and its score is the
    sum of w * (1000000000 tf div (1000 tf + 12 m)) over the terms of the item with repeats, in 64-bit integers.

    One pass over the documents counts the terms that items have into shards of at most 8,192 documents; terms of no item are
    told by a filter of fixed size. Terms are dealt to ``owners``. A bundle is the accumulators of up to 128 items over one shard; it
    visits one owner after the other, each a cogroup of the bundles with the owner's postings of the same
    shard, so that a task holds one shard whatever the number of documents that share a term. The last visit
    keeps the best k of the shard, and these are ranked over all shards.

    A null or empty text has no terms; such a document is never found, such an item finds nothing. Rows of one item (null is
    an id like others) are one item that has the terms of its different texts. Repeated documents count each, those without a key come last
    among equals. Extra columns are ignored. The result is stored in the shared folder; the tables made on the way are deleted.
    """
    uses = written(_item_terms(items, item, item_text), "search-uses")
    numbers = written(uses.select("item").distinct().withColumn("number", F.monotonically_increasing_id()), "search-items")
    postings = written(_postings(docs, key, text, _filter(uses)), "search-postings")
    shards = postings.filter("term is null")
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n"), F.sum("total")).first())
    weights = postings.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).alias("weight"))
    asked = uses.join(numbers, uses["item"].eqNullSafe(numbers["item"])).select(
        F.shiftright("number", 7).alias("bundle"), "term", F.struct((F.col("number") % BUNDLE_ITEMS).cast("int").alias("slot"), "q").alias("use"))
    asked = asked.groupBy("bundle", "term").agg(F.collect_list("use").alias("uses")).join(weights, "term")
    owned = written(
        postings.filter("term is not null").select("shard", "term", "n", "body").join(asked, "term").select(
            "bundle", "shard", "n", "body", "weight", "uses", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(owners)).alias("owner")), "search-owned")
    bundles = owned.select("bundle", "shard").distinct().join(shards.select("shard", "keys", F.col("body").alias("lengths")), "shard").select(
        "bundle", "shard", "keys", "lengths", F.lit(None).cast("array<int>").alias("slots"), F.lit(None).cast("array<binary>").alias("scores"))
    moving, kind = bundles.schema, shards.schema["keys"].dataType.elementType
    found_schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("key", kind), T.StructField("score", T.LongType())])

    def on(left, right):
        scores = _visit(left, right, n_docs, n_terms)
        slots = np.flatnonzero(scores.any(axis=1)).tolist()
        kept = left.select(["bundle", "shard", "keys", "lengths"])
        return kept.append_column("slots", pa.array([slots], pa.list_(pa.int32()))).append_column(
            "scores", pa.array([[_pack(scores[s]) for s in slots]], pa.list_(pa.binary())))

    def last(left, right):
        scores, number = _visit(left, right, n_docs, n_terms), left.column("bundle")[0].as_py() << 7
        of, docs_of, points = [], [], []
        for slot in np.flatnonzero(scores.any(axis=1)):
            row = scores[slot]
            least = max(1, int(np.partition(row, -k)[-k])) if len(row) > k else 1
            able = np.flatnonzero(row >= least)
            best = able[np.lexsort((able, -row[able]))[:k]]
            of += [number + int(slot)] * len(best)
            docs_of.append(best)
            points.append(row[best])
        keys = left.column("keys").combine_chunks().flatten()
        taken = keys.take(pa.array(np.concatenate([np.empty(0, np.int64), *docs_of]), pa.int64()))
        return pa.table([pa.array(of, pa.int64()), taken, pa.array(np.concatenate([np.empty(0, np.int64), *points]), pa.int64())], found_schema.names)

    for s in range(owners):
        visit, schema = (last, found_schema) if s == owners - 1 else (on, moving)
        part = owned.filter(F.col("owner") == s).select(*[F.col(c).alias(c) for c in owned.columns if c != "owner"])
        bundles = bundles.groupBy("bundle", "shard").cogroup(part.groupBy("bundle", "shard")).applyInArrow(visit, schema)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))
    best = bundles.withColumn("place", rank).filter(F.col("place") <= k).join(numbers, "number")
    rank_name, score_name = fresh("rank", [item, key]), fresh("score", [item, key])
    result = written(best.select(
        F.col("item").alias(item), F.col("place").cast("int").alias(rank_name), F.col("key").alias(key), F.col("score").alias(score_name)), "search-result")
    for table in (uses, numbers, postings, owned):
        release(table)
    return result
