"""N-gram scores of whole texts by a weighted backoff automaton.

Every word of a training text is a class of its own, unseen words are one class, and the end of a text is another
(which also stands before its beginning). With ``CLASSES`` set, only so many words are classes of their own and
the others join the unseen ones; the probability of a word is that of its class after the classes before it,
times that of the word in its class. Class n-grams are smoothed with the next shorter history,

    P(x | h) = (c(h x) + m P(x | h')) / (c(h) + m),        m = max(PRIORS[length of h], d(h)),

where d(h) is how many different classes follow a class, and of a pair the bound min(c(h), d(last of h)),
down to the word frequencies themselves, (c + 0.5) / (N + 0.5 (V + 1)), so all probabilities sum to one. As an
automaton: a history that occurs is a state, an n-gram an arc with its weight, and every state has a failure arc to the
next shorter history that carries log m / (c(h) + m).

The counts cover every training text and grow with the corpus, so no task holds them all. Every text is read once, into
shards of bounded text that hold their words' 64-bit hashes and each text as numbers of words. A shard asks for the
counts of its words, then of its pairs, then of its triples, by 64-bit hashes of the words' hashes. The hashes travel sorted,
as differences and by ranges; a range is summed up in one place, and its answers go back without the hashes, in the order in which the
shard has asked. A triple is asked for only if both its pairs are in the training texts and in other shards too:
the shard itself counts the others, of which it has every copy. A shard reads its texts a bounded part at a time, each part with the
sub-automaton of just its own n-grams.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import col, first_rows, largest, text_slices
from tamhis.workspace import settings, shuffles_released, written

#: So many of the most frequent words are classes of their own; None: all words.
CLASSES = None
#: By length of the history: how many occurrences the shorter history is worth.
PRIORS = (0, 300.0, 300.0)
#: Text of a shard, in bytes, and its words; the last text goes beyond them.
SHARD_BYTES, SHARD_WORDS = 16 << 20, 3_000_000
#: Text whose n-grams make one range of hashes, in bytes, and the least number of ranges.
RANGE_BYTES, LEAST_RANGES = 8 << 20, 64
#: Without effect since shards are no longer cut by file.
CUT_FILES = 100_000
#: Texts are read in lanes of so many words that advance together.
LANE = 64
#: Words that are numbered together, and the longest piece of a text among them; numbers have ``BITS`` bits.
PART_WORDS, LINE_WORDS, BITS = 1 << 20, 1 << 19, 21
END, RARE = 0, 1  # class numbers, and the keys that stand for them among the words' keys
NO_WORD = 2  # a key that no word has
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NUMBER, _TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
_ASKED = "range long, shard long, keys binary, n binary"
_ANSWERED = "shard long, range long, answers binary, owned long, distinct long"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def word_key(word: bytes) -> int:
    """XXH64 as a signed long; the three keys above are left free."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else max(h, NO_WORD + 1)


class _Numbers(dict):
    """Words by order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 up, in as few bytes each as the largest needs: all lowest bytes, then all next ones, compressed."""
    numbers = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    packer = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return bytes([numbers.itemsize]) + packer.compress(planes) + packer.flush()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel()


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Different numbers in order. np.unique puts them into a hash table first, which takes several times as long."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=~numbers[:1]) != 0]


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


_SHARD = [("shard", T.LongType()), ("ends", T.LongType()), ("bytes", T.LongType()), *[(c, T.BinaryType()) for c in (
    "sizes", "learn", "words", "trained", "seen", "tokens")]]


def sharded(docs: DataFrame, key: str, text: str, learn) -> DataFrame:
    """One row per shard: consecutive texts of a task, up to ``SHARD_BYTES`` and ``SHARD_WORDS``.

    keys, sizes (words) and learn of every text; the different words' keys in order, the end (0) first, how often each is in
    training texts (``trained``) and in all; the words of all texts, as places in the order of falling frequency.
    """
    rows = docs.select(col(key).alias("key"), col(text).cast("string").cast("binary").alias("text"), learn.alias("learn"))
    schema = T.StructType([T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), *[T.StructField(*f) for f in _SHARD]])

    def run(batches):
        def shard():
            size = np.array([len(x) for x in lines])
            use = np.array(learns, bool)
            found = np.fromiter(map(word_key, numbers), np.int64, len(numbers)).view(np.uint64)
            words, place = np.unique(np.concatenate([np.array([END], np.uint64), found]), return_inverse=True)
            tokens = place[1:][np.concatenate(lines)]
            seen = np.bincount(tokens, minlength=len(words))
            trained = np.bincount(tokens[np.repeat(use, size)], minlength=len(words))
            trained[END] = use.sum()
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-seen, kind="stable")] = np.arange(len(words))
            own = pa.concat_arrays(keys)
            row = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            row += [pa.array([n], pa.int64()) for n in (task << 32 | made, int(use.sum()), volume)]
            row += [pa.array([x], pa.binary()) for x in (
                _pack(size), _pack(use.astype(np.uint8)), _pack_sorted(words), _pack(trained), _pack(seen), _pack(rank[tokens]))]
            return pa.RecordBatch.from_arrays(row, schema.names)

        task, made = TaskContext.get().partitionId(), 0
        numbers, lines, learns, keys, volume, count = _Numbers(), [], [], [], 0, 0
        for batch in batches:
            for part in text_slices(batch, 1):
                start = 0
                for i, (text, use) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    found = words_of(text)
                    lines.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    learns.append(use)
                    volume, count = volume + len(text or b""), count + len(found)
                    if volume >= SHARD_BYTES or count >= SHARD_WORDS:
                        keys.append(part.column(0).slice(start, i + 1 - start))
                        yield shard()
                        start, made = i + 1, made + 1
                        numbers, lines, learns, keys, volume, count = _Numbers(), [], [], [], 0, 0
                if start < part.num_rows:
                    keys.append(part.column(0).slice(start))
        if lines:
            yield shard()

    return rows.mapInArrow(run, schema)


def class_grams(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and triples (packed) of a text's classes between two ends."""
    return _packed(np.concatenate([[END], classes, [END]]))


def _packed(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = line[:-1] << BITS | line[1:]
    return pairs, pairs[:-1] << BITS | line[2:]


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the pairs of words with the keys a and b (all unsigned)."""
    return _mixed(_mixed(a + np.uint64(0x9E3779B97F4A7C15)) + b)


def triple_keys(pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mixed(pairs * np.uint64(0xD6E8FEB86659FD93) + c)


def _follower_keys(words: np.ndarray) -> np.ndarray:
    """Keys by which the number of different words after a word is asked for."""
    return _mixed(words ^ np.uint64(0xA0761D6478BD642F))


class _Shard:
    """A shard's texts as one line of word keys: an end, then every text with an end after it."""

    def __init__(self, table: pa.Table, own_class: dict | None):
        packed = {c: table.column(c)[0].as_py() for c in ("sizes", "learn", "words", "trained", "seen", "tokens")}
        self.sizes, self.learn = _unpack(packed["sizes"]).astype(np.int64), _unpack(packed["learn"]) > 0
        self.words, self.trained = _unpack_sorted(packed["words"]), _unpack(packed["trained"]).astype(np.int64)
        order = np.argsort(-_unpack(packed["seen"]).astype(np.int64), kind="stable")
        self.tokens = order[_unpack(packed["tokens"])]
        self.classes = self.words  # keys of the words' classes
        if own_class is not None:
            own = np.array([k == END or k in own_class for k in self.words.view(np.int64).tolist()], bool)
            self.classes = np.where(own, self.words, np.uint64(RARE))

    def count_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs in order of their keys, and how often each is in the shard's training texts."""
        inside = np.ones(len(self.tokens) + len(self.sizes) + 1, bool)
        inside[0] = inside[np.cumsum(self.sizes + 1)] = False
        self.line = np.zeros(len(inside), np.uint64)
        self.line[inside] = self.classes[self.tokens]
        self.used = np.repeat(self.learn, self.sizes + 1)  # of all but the first end
        self.at = pair_keys(self.line[:-1], self.line[1:])
        self.pairs, self.pair_of = np.unique(self.at, return_inverse=True)
        self.own_pairs = np.bincount(self.pair_of[self.used], minlength=len(self.pairs))
        return self.pairs, self.own_pairs

    def settle(self, words: np.ndarray, pairs: np.ndarray) -> None:
        """Take the answers for the words and the pairs; find out what else is to be asked for."""
        self.word_counts = _settled(words, self.trained)[0]
        self.count_pairs()
        self.pair_counts, owner = _settled(pairs, self.own_pairs)
        shared = (pairs > 0) & (self.pair_counts > 0)
        whole = self.line[1:-1] != END  # triples that lie in one text
        self.open = whole & shared[self.pair_of[:-1]] & shared[self.pair_of[1:]]
        self.closed = whole & ~self.open & self.used[1:]
        # only words that are more frequent than the prior can have more followers than it
        self.heads = _distinct(self.classes[(self.word_counts > PRIORS[1]) | (self.classes == RARE)])
        first = np.empty(len(self.pairs), np.uint64)
        first[self.pair_of] = self.line[:-1]
        first = first[owner]
        place, found = Automaton._arcs(self.heads, first)
        followers = np.bincount(place[found], minlength=len(self.heads))
        triples = triple_keys(self.at[:-1][self.open], self.line[2:][self.open])
        keys = np.concatenate([triples, _follower_keys(self.heads)])
        self.rest, self.rest_of = np.unique(keys, return_inverse=True)
        n = np.concatenate([self.used[1:][self.open].astype(np.int64), followers])
        self.own_rest = np.bincount(self.rest_of, n, len(self.rest)).astype(np.int64)

    def grams(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With the answers for the rest: n-grams of the training texts in order, their counts, and the followers of ``heads``."""
        rest_counts, _ = _settled(rest, self.own_rest)
        closed, n = np.unique(triple_keys(self.at[:-1][self.closed], self.line[2:][self.closed]), return_counts=True)
        keys, counts = np.concatenate([self.pairs, self.rest, closed]), np.concatenate([self.pair_counts, rest_counts, n])
        keys, counts = keys[counts > 0], counts[counts > 0]
        order = np.argsort(keys)
        return keys[order], counts[order], rest_counts[self.rest_of[len(self.rest_of) - len(self.heads):]]


def _settled(answers: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all shards, and which of them the shard is the one to report."""
    shared = answers > 0
    return np.where(shared, (answers >> 1) - 1, own), np.where(shared, answers & 1, own) > 0


def _asks(shard: int, keys: np.ndarray, n: np.ndarray, ranges: int) -> pa.Table:
    """A row for every range of hashes in which a shard has keys."""
    place = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    first = np.flatnonzero(np.diff(place, prepend=np.uint64(1 << 63)))
    cuts = [slice(*c) for c in zip(first, [*first[1:], len(keys)])]
    return pa.table([pa.array(place[first].astype(np.int64)), pa.array([shard] * len(cuts), pa.int64()),
                     pa.array([_pack_sorted(keys[c]) for c in cuts], pa.binary()), pa.array([_pack(n[c]) for c in cuts], pa.binary())],
                    ["range", "shard", "keys", "n"])


def _answer(asked: pa.Table) -> pa.Table:
    """For every shard that asks in a range, in the order of its keys: 0 if no other shard asks for the key, else twice the sum
    of all counts plus one, and 1 more for the shard that reports it (the first that counts any). And what it reports."""
    shards, keys, n = ([x.as_py() for x in asked.column(c)] for c in ("shard", "keys", "n"))
    keys = [_unpack_sorted(k) for k in keys]
    ends = np.cumsum([0, *map(len, keys)])
    keys, n = np.concatenate(keys), np.concatenate([_unpack(x) for x in n]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    total = np.add.reduceat(n, first)[group]
    shared = (np.diff(first, append=len(keys)) > 1)[group]
    counting = np.flatnonzero(n)
    owner = np.zeros(len(keys), np.int64)
    owner[counting[np.diff(group[counting], prepend=-1) > 0]] = 1
    answers, owned = np.empty((2, len(keys)), np.int64)
    answers[order], owned[order] = np.where(shared, 2 * (total + 1) + owner, 0), total * owner
    cuts = [slice(*c) for c in zip(ends[:-1], ends[1:])]
    return pa.table([pa.array(shards, pa.int64()), asked.column("range"), pa.array([_pack(answers[c]) for c in cuts], pa.binary()),
                     pa.array([int(owned[c].sum()) for c in cuts], pa.int64()),
                     pa.array([int(np.count_nonzero(owned[c])) for c in cuts], pa.int64())],
                    ["shard", "range", "answers", "owned", "distinct"])


def _answers(table: pa.Table, step: int) -> np.ndarray:
    """The answers of one step to a shard, in the order of its keys."""
    found = table.filter(pc.equal(table.column("step"), step)).sort_by("range")
    return np.concatenate([np.empty(0, np.int64), *[_unpack(x.as_py()).astype(np.int64) for x in found.column("answers")]])


def _ask_words(ranges):
    def run(batches):
        for batch in batches:
            for shard, words, trained in zip(*(batch.column(c).to_pylist() for c in range(3))):
                yield from _asks(shard, _unpack_sorted(words), _unpack(trained), ranges).to_batches()

    return run


def _ask_pairs(shared, ranges):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                yield from _asks(row.column("shard")[0].as_py(), *_Shard(row, shared.value).count_pairs(), ranges).to_batches()

    return run


def _ask_rest(shared, ranges):
    """Asks for the triples of pairs that other shards have too, and for the followers of frequent words."""
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        shard = _Shard(row, shared.value)
        shard.settle(_answers(answers, 0), _answers(answers, 1))
        return _asks(row.column("shard")[0].as_py(), shard.rest, shard.own_rest, ranges)

    return run


def _reported_words(row: pa.Table, answers: pa.Table) -> pa.Table:
    """(word, c): counts of the training words that a shard is the one to report."""
    words = _unpack_sorted(row.column("words")[0].as_py())
    counts, owner = _settled(_answers(answers, 0), _unpack(row.column("trained")[0].as_py()).astype(np.int64))
    return pa.table([pa.array(words[owner].view(np.int64)), pa.array(counts[owner])], ["word", "c"])


class Automaton:
    """States are histories, numbered: 0 the empty one, 1 + class, then the pairs that occur."""

    def __init__(self, pairs, pair_counts, triples, triple_counts, class_counts, class_probs, followers=0):
        self.classes = len(class_probs)
        self.pairs, self.triples = pairs, triples
        a, b = pairs >> BITS, pairs & _NUMBER
        followers = np.broadcast_to(followers, self.classes)
        m1 = np.maximum(PRIORS[1], followers)
        m2 = np.maximum(PRIORS[2], np.minimum(pair_counts, followers[b]))
        p2 = (pair_counts + m1[a] * class_probs[b]) / (class_counts[a] + m1[a])
        self.root = np.log10(class_probs)
        self.pair_weight, self.pair_state = np.log10(p2), 1 + self.classes + np.arange(len(pairs))
        self.triple_weight, self.triple_state = np.empty(len(triples)), np.empty(len(triples), np.int32)
        for k in range(0, len(triples), 1 << 18):  # in pieces, for the sake of memory
            some = slice(k, k + (1 << 18))
            inner = np.searchsorted(pairs, triples[some] >> BITS)
            outer = np.searchsorted(pairs, triples[some] & _TWO)
            self.triple_weight[some] = np.log10((triple_counts[some] + m2[inner] * p2[outer]) / (pair_counts[inner] + m2[inner]))
            self.triple_state[some] = self.pair_state[outer]
        one, two = np.log10(m1 / (class_counts + m1)), np.log10(m2 / (pair_counts + m2))
        self.fail_weight = np.concatenate([[0.0], one, two])
        self.fail_state = np.concatenate([np.zeros(1 + self.classes, np.int64), 1 + b])
        self.tail = np.concatenate([[0], np.arange(self.classes), pairs])  # classes of the history, packed

    def start(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The state after two classes (the longest history that is a state)."""
        at, found = self._arcs(self.pairs, before << BITS | last)
        return np.where(found, 1 + self.classes + at, 1 + last)

    @staticmethod
    def _arcs(table, keys):
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def step(self, state: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities: failure arcs are followed until a state has an arc for the class."""
        score, after = np.zeros(len(state)), 1 + read
        left = np.arange(len(state))
        for table, low, weight, to in (
                (self.triples, 1 + self.classes, self.triple_weight, self.triple_state),
                (self.pairs, 1, self.pair_weight, self.pair_state)):
            deep = state[left] >= low
            rows = left[deep]
            at, found = self._arcs(table, self.tail[state[rows]] << BITS | read[rows])
            hit, miss = rows[found], rows[~found]
            score[hit] += weight[at[found]]
            after[hit] = to[at[found]]
            score[miss] += self.fail_weight[state[miss]]
            state = state.copy()
            state[miss] = self.fail_state[state[miss]]
            left = np.concatenate([left[~deep], miss])
        score[left] += self.root[read[left]]
        return after, score

    def read(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's classes, its end included."""
        lines = [np.concatenate([[END], t, [END]]) for t in texts]
        return self.read_lines(np.concatenate(lines), np.array([len(x) for x in lines]), np.ones(len(lines), np.int64))

    def read_lines(self, line: np.ndarray, size: np.ndarray, given: np.ndarray) -> np.ndarray:
        """log10 probability of every line (``size`` classes of ``line``) after its first one (the end) or two classes.

        The lines are cut into lanes that are read from left to right, all lanes one word at a time; a lane that does
        not begin a text starts in the state its two classes before lead to.
        """
        lanes = -(-(size - given) // LANE)
        owner = np.repeat(np.arange(len(size)), lanes)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        base = np.concatenate([[0], np.cumsum(size)])
        begin = base[owner] + given[owner] - 1 + first  # what stands before the lane's first word
        stop = np.minimum(begin + LANE, base[owner + 1] - 1)
        inside = begin > base[owner]
        state = np.where(inside, self.start(line[np.maximum(begin - 1, 0)], line[begin]), 1 + END)
        total = np.zeros(len(owner))
        order = np.argsort(begin - stop, kind="stable")  # longest lanes first, so that the active ones are a prefix
        state, begin, length = state[order], begin[order], (stop - begin)[order]
        for k in range(LANE):
            active = int(np.searchsorted(-length, -k, "left"))
            if not active:
                break
            state[:active], score = self.step(state[:active], line[begin[:active] + 1 + k])
            total[order[:active]] += score
        return np.bincount(owner, total, len(size))


def score_texts(docs: DataFrame, learn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every whole text; ``learn`` marks training rows.

    Tokens are the words (runs of anything but ASCII white space, A-Z in lower case) and one end. base_score is the
    unigram log10 probability, score that of the automaton. A null text is empty: just the end. Null keys stay null; a
    null mark is no training row; repeated rows are counted and scored each. Without a training text every
    probability is 1 and both scores 0. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    with shuffles_released(spark):
        shards = written(sharded(docs, key, text, F.coalesce(learn, F.lit(False))), "shards", rows_per_file=1)
        volume, ends = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
        ranges = max(LEAST_RANGES, -(-volume // RANGE_BYTES))

        def answered(asked: DataFrame, step: int) -> DataFrame:
            # an Arrow batch is all that a task reads, so it is to read few shards
            with settings(spark, {"spark.sql.files.maxPartitionBytes": str(SHARD_BYTES)}):
                return written(asked.groupBy("range").applyInArrow(_answer, _ANSWERED), "answers").withColumn("step", F.lit(step))

        words = answered(shards.select("shard", "words", "trained").mapInArrow(_ask_words(ranges), _ASKED), 0)
        total, distinct = words.agg(F.coalesce(F.sum("owned"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        own_class, rare = None, (0, 0.5 / (total + 0.5 * (distinct + 1)))  # count, probability
        if CLASSES is not None:
            heads = written(shards.select("shard", "words", "trained").groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(
                _reported_words, "word long, c long"), "words")
            top = first_rows(heads.filter(F.col("word") != END), CLASSES, largest(F.col("c")), F.desc("c"), F.col("word"))
            own_class = dict(top.select("word", "c").collect())
            counts = np.array([ends, *own_class.values()], np.float64)
            rare = total - counts.sum(), 1 - ((counts + 0.5) / (total + 0.5 * (distinct + 1))).sum()
        shared = spark.sparkContext.broadcast(own_class)
        answers = words
        if total:
            lines = shards.drop("keys", "ends", "bytes")
            answers = words.union(answered(lines.mapInArrow(_ask_pairs(shared, ranges), _ASKED), 1))
            asked = lines.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_ask_rest(shared, ranges), _ASKED)
            answers = answers.union(answered(asked, 2))
    out = T.StructType([T.StructField(key, docs.select(col(key)).schema[0].dataType)] + [
        T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [
        T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])
    scorer = _scorer(shared, int(ends), rare, int(total), int(distinct), out.names)
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(scorer, out)


def _look_up(table: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns of the keys, 0 for those that are not in the (ordered) table; asked in order, which is kinder to the cache."""
    order = np.argsort(keys)
    at, found = Automaton._arcs(table, keys[order])
    out = [np.zeros(len(keys), np.int64) for _ in columns]
    for values, column in zip(out, columns):
        values[order[found]] = column[at[found]]
    return out


def _read_part(line: np.ndarray, size: np.ndarray, given: np.ndarray, count_of, grams, gram_counts, rare, scale) -> np.ndarray:
    """log10 probability of every line of word keys, by the automaton of just these lines' n-grams."""
    alphabet, line = np.unique(np.concatenate([np.array([END, RARE], np.uint64), line]), return_inverse=True)
    line = line[2:]
    counts, followers = (x.astype(np.float64) for x in count_of(alphabet))
    probs = (counts + 0.5) / scale
    counts[RARE], probs[RARE], followers[RARE] = rare
    pairs, triples = _packed(line)
    ends = np.cumsum(size)[:-1]
    pairs = _distinct(np.delete(pairs, ends - 1))
    # no triple goes over the end of a line; a line has two classes at least
    triples = _distinct(np.delete(triples, np.concatenate([ends - 2, ends - 1]))) if len(triples) else triples
    pair_counts, = _look_up(grams, pair_keys(alphabet[pairs >> BITS], alphabet[pairs & _NUMBER]), gram_counts)
    inner = triples >> BITS
    before = pair_keys(alphabet[inner >> BITS], alphabet[inner & _NUMBER])
    triple_counts, = _look_up(grams, triple_keys(before, alphabet[triples & _NUMBER]), gram_counts)
    seen, deep = pair_counts > 0, triple_counts > 0
    automaton = Automaton(pairs[seen], pair_counts[seen], triples[deep], triple_counts[deep], counts, probs, followers)
    return automaton.read_lines(line, size, given)


def _scorer(shared, ends, rare, total, distinct, names):
    scale = total + 0.5 * (distinct + 1)

    def score(row: pa.Table, answers: pa.Table) -> pa.Table:
        shard = _Shard(row, shared.value)
        size, followers = np.zeros(len(shard.words), np.int64), np.zeros(len(shard.words), np.int64)
        rare_class = *rare, 0
        if total:
            shard.settle(_answers(answers, 0), _answers(answers, 1))
            grams, gram_counts, found = shard.grams(_answers(answers, 2))
            size = shard.word_counts
            place, known = Automaton._arcs(shard.words, shard.heads)
            followers[place[known]] = found[known]
            rare_class = *rare, int(found[shard.heads == RARE].sum())
        tokens, sizes, words = shard.tokens, shard.sizes, shard.words
        keys = np.where(size > 0, shard.classes, np.uint64(RARE))
        del shard
        end_base = math.log10((ends + 0.5) / scale)
        base = np.log10((size + 0.5) / scale)
        inner = np.where(keys == RARE, base - math.log10(rare[1]), 0.0) if total else np.zeros(len(base))
        columns = [sizes + 1, [], [total] * len(sizes), [], np.zeros(len(sizes))]
        scores = columns[4]
        waiting, held = [], 0  # (text's number, line, classes given), and their words

        def count_of(alphabet):
            return _look_up(words, alphabet, size, followers)

        def read():
            owner, lines, given = zip(*waiting)
            by_line = _read_part(np.concatenate(lines), np.array([len(x) for x in lines]), np.array(given), count_of, grams,
                                 gram_counts, rare_class, scale)
            np.add.at(scores, np.array(owner), by_line)
            waiting.clear()

        for number, x in enumerate(np.split(tokens, np.cumsum(sizes)[:-1])):
            if total:
                scores[number] += inner[x].sum()
                line = np.concatenate([np.zeros(1, np.uint64), keys[x], np.zeros(1, np.uint64)])
                for k in range(0, len(x) + 1, LINE_WORDS):  # words k to k + LINE_WORDS after one or two before them
                    waiting.append((number, line[max(0, k - 1): k + 1 + LINE_WORDS], 2 if k else 1))
                    held += len(waiting[-1][1])
                    if held >= PART_WORDS:
                        read()
                        held = 0
            columns[1].append(int((size[x] > 0).sum()) + int(ends > 0))
            columns[3].append(float(base[x].sum()) + end_base)
        if waiting:
            read()
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        own = pa.concat_arrays([c.flatten() for c in row.column("keys").chunks])
        return pa.table([own, *[pa.array(v, k) for v, k in zip(columns, kinds)]], names)

    return score
