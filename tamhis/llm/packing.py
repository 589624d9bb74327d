"""Token packing: documents cut into pieces and dealt to sequences of balanced attention cost."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tamhis.llm.common import Lists, col, kept, text_slices

CAPACITY = 2048
END_ID = 1
#: Cost of a piece of n tokens: n + n * n / LINEAR_TOKENS (projections grow with n, attention with its square).
LINEAR_TOKENS = 1024
#: Sequences that are filled together.
GROUP_SEQUENCES = 256
#: Largest tokenizer file that is sent to the executors.
TOKENIZER_BYTES = 64 << 20
#: Distinct chunks whose ids a Python worker keeps.
CHUNKS = 1_500_000


class Numbers(dict):
    """Numbers words as they are first met, and lists the words ``new`` since the list was last emptied."""

    def __init__(self):
        self.new = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Token ids of texts; each distinct white-space separated chunk is encoded once per (bounded) table.

    Exact for tokenizers that never join characters across ASCII white space and give it no ids of its own, such
    as the word-level BPE this is used with; the tests compare with encoding whole texts.
    """

    def __init__(self, content: str, limit: int = CHUNKS):
        self.tokenizer = Tokenizer.from_str(content)
        self.chunks, self.ids, self.limit = Numbers(), Lists(np.uint32), limit

    def _learn(self, new: list) -> None:
        """Encode new chunks as one line; character offsets tell which chunk an id belongs to."""
        line = [c.decode("utf-8", "replace") for c in new]
        begin = np.cumsum([0, *[len(c) + 1 for c in line]])
        found = self.tokenizer.encode(" ".join(line), add_special_tokens=False)
        starts = np.array([a for a, _ in found.offsets], np.int64)
        owner = np.searchsorted(begin, starts, "right") - 1
        ends = np.cumsum(np.bincount(owner, minlength=len(new))) if len(starts) else np.zeros(len(new), np.int64)
        before = self.ids.flat.n
        self.ids.flat.extend(np.array(found.ids, np.uint32))
        self.ids.start.extend(before + ends)

    def encode(self, texts: list) -> list[np.ndarray]:
        split = [_fold(t).split() if t else [] for t in texts]
        if len(self.chunks) >= self.limit:
            self.chunks.clear()
            self.ids.clear()
        number = self.chunks.__getitem__
        numbers = [np.fromiter(map(number, s), np.int64, len(s)) for s in split]
        if self.chunks.new:
            self._learn(self.chunks.new)
            self.chunks.new = []
        return [self.ids.gather(n)[0] for n in numbers]


def _fold(text: bytes) -> bytes:
    """Lower-case A-Z where the tokenizer's own lower-casing makes that the same: no combining marks (bytes CC and
    CD), which compose before case is folded, and no special tokens, which are found first."""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        content = file.read(TOKENIZER_BYTES + 1)
    if len(content) > TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {TOKENIZER_BYTES} characters")
    return content


def cost(n):
    return n + n * n / LINEAR_TOKENS


def deal(lengths, room) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items dealt to sequences with the given room.

    Items go in descending order, each to the lowest-cost sequence that can hold it whole, else piece by piece to
    the lowest-cost sequences that have any room. The room must suffice for all.
    """
    free = np.array(room, np.int64)
    size, load = free.copy(), np.zeros(len(free))
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = free >= left
            able = fits if fits.any() else free > 0
            to = int(np.where(able, load, np.inf).argmin())
            n = min(left, int(free[to]))
            pieces.append((item, start, n, to, int(size[to] - free[to])))
            free[to] -= n
            load[to] += cost(n)
            start, left = start + n, left - n
    return pieces


def tail_sizes(n: int) -> list[int]:
    """Powers of two that sum to n."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Fills groups of sequences from a stream of (key, ids); memory is one group and one document."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.waiting, self.tokens = [], 0  # (key, ids not yet packed, ids before them, ids of the document)

    def add(self, key, ids: np.ndarray):
        """Pieces that are ready. Whole sequences of a long document leave at once, its rest waits."""
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield _piece(key, ids[start:start + self.capacity], start, len(ids), self.sequence, 0)
            self.sequence += 1
        if whole < len(ids):
            self.waiting.append((key, ids[whole:].copy(), whole, len(ids)))
            self.tokens += len(ids) - whole
        if self.tokens >= (GROUP_SEQUENCES + 1) * self.capacity:
            yield from self._fill([self.capacity] * GROUP_SEQUENCES)

    def end(self):
        """The rest: full sequences, then shorter ones whose lengths are powers of two."""
        yield from self._fill([self.capacity] * (self.tokens // self.capacity) + tail_sizes(self.tokens % self.capacity))

    def _fill(self, room):
        """Deal waiting rests to sequences of the given sizes; what came last and has no room waits on."""
        over, later = self.tokens - sum(room), []
        self.tokens = over
        while over:
            key, ids, start, total = self.waiting.pop()
            cut = max(0, len(ids) - over)
            later.append((key, ids[cut:], start + cut, total))
            over -= len(ids) - cut
            if cut:
                self.waiting.append((key, ids[:cut], start, total))
        now, self.waiting = self.waiting, later[::-1]
        for item, start, n, to, offset in deal([len(ids) for _, ids, _, _ in now], room):
            key, ids, before, total = now[item]
            yield _piece(key, ids[start:start + n], before + start, total, self.sequence + to, offset)
        self.sequence += len(room)


def _piece(key, ids, start, total, sequence, offset):
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    return key, start, len(ids), crc, total, sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (longs).

    A document is the ids of its whole text, then ``end_id``; a null or empty text is the end id alone, and a null
    key stays null. Every id lies in exactly one piece; repeated rows are documents of their own. Sequences hold
    ``capacity`` ids; the last few of a task are shorter, of lengths that are powers of two, so there
    is no padding. Ties in length or cost go to the earlier document or sequence. Each task packs the documents
    it reads, so nothing is shuffled; a sequence id is made of the task's partition and a running
    number, so a task that runs again replaces its own sequences. Pass a stored table: a task that reads the same rows
    again packs them the same way. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    narrow = docs.select(col(key).alias(key), col(text).cast("string").cast("binary").alias("bytes_" + key))
    schema = T.StructType([narrow.schema.fields[0], *[T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])

    def run(batches):
        encoder = kept("encoder", hash(shared.value), lambda: Encoder(shared.value))
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        kind = None

        def out(pieces):
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in text_slices(batch, 1):
                pieces = []
                for own, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    pieces += packer.add(own, np.append(ids, np.uint32(end_id)))
                if pieces:
                    yield out(pieces)
        if packer.tokens:
            yield out(list(packer.end()))

    return narrow.mapInArrow(run, schema)
